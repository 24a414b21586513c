"""The same queries as SQL for DuckDB, as chains of common table expressions."""

from __future__ import annotations

from ..functions.lexicon import COUNTRY_FOLDS, DOMAIN_ENDINGS, LEGAL_SUFFIXES, LETTERS, STREET_FOLDS, SUFFIX_FOLDS
from ..operators.features import ACCURACY, BASE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(x: str, folds: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in folds.items()) + f" ELSE {x} END"


#: The oracle's own patterns, none of them shared with the engine.
WORD_CHARS = r"\p{L}\p{N}_"
NUMBER = r"\b[0-9]+\b"
STROKES = ("øđłħŧƀɨɵʉ", "odlhtbiou")


def clean(x: str) -> str:
    out = f"translate(lower(strip_accents({x})), {q(STROKES[0])}, {q(STROKES[1])})"
    for letter, plain in LETTERS.items():
        out = f"replace({out}, {q(letter)}, {q(plain.lower())})" if letter.islower() else out
    return f"trim(regexp_replace({out}, {q('[^' + WORD_CHARS + r'\p{M}]+')}, ' ', 'g'))"


def domain(x: str) -> str:
    name = f"trim({x})"
    server = rf"regexp_extract({name}, '^(?:[hH][tT][tT][pP][sS]?://)?([a-zA-Z0-9.-]+)(:[0-9]+)?(/[^\n]*)?$', 1)"
    host = f"regexp_replace({server}, '^[wW][wW][wW][0-9]?[.](.)', '\\1')"
    ending = "(?i)[.](" + "|".join(e.replace(".", "[.]") for e in sorted(DOMAIN_ENDINGS, key=len, reverse=True)) + ")$"
    return f"CASE WHEN (contains({x}, '.') OR contains({x}, '/')) AND {server} <> '' THEN {clean(f'regexp_replace(regexp_replace({host}, {q(ending)}, {q('')}), {q('[._-]')}, {q(' ')}, {q('g')})')} ELSE {clean(x)} END"


def words(x: str, least: int = 2) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: length(w) >= {least}))"


def pieces(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(1, length({x}) - {n - 2})), lambda i: substr({x}, i, {n}))"


def ngrams(x: str, n: int) -> str:
    tight = f"replace({x}, ' ', '')"
    return f"CASE WHEN length({tight}) >= {n} THEN list_distinct({pieces(tight, n)}) WHEN {tight} <> '' THEN [{tight}] ELSE [] END"


def both(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    return f"coalesce({both(a, b)} / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::DOUBLE, 0.0)"


def overlap(a: str, b: str) -> str:
    return f"coalesce({both(a, b)} / nullif(least(len({a}), len({b})), 0)::DOUBLE, 0.0)"


def prefix(a: str, b: str) -> str:
    return f"coalesce(len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i))) / nullif(least(length({a}), length({b})), 0)::DOUBLE, 0.0)"


def levenshtein(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> '' AND {b} <> '' THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE ELSE 0.0 END"


def ratio(a: str, b: str) -> str:
    """Twice the longest common subsequence by both lengths; strings of at most 125 characters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = substr({b}, j, 1) THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: {mask})"
    left = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2 * (length({a}) - bit_count({left})) / (length({a}) + length({b}))::DOUBLE END"


def sorted_words(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' ')"


def suffix(x: str) -> str:
    found = f"list_filter(string_split({x}, ' '), lambda w: w IN ({', '.join(map(q, LEGAL_SUFFIXES))}))"
    return case(f"({found})[-1]", SUFFIX_FOLDS)


def joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


def bigrams(x: str) -> str:
    s = f"list_sort({words(x)})"
    return f"list_transform(range(1, greatest(1, len({s}))), lambda i: ({s})[i] || ' ' || ({s})[i + 1])"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {q(NUMBER)}))"


def postals(x: str) -> str:
    cedex = r"\b(?:cedex|bp)(?:\s+[0-9]+)?\b"
    return f"list_distinct(list_concat(list_filter({numbers(x)}, lambda n: length(n) IN (5, 6)), regexp_extract_all(lower({x}), {q(cedex)})))"


def phones(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(regexp_replace({x}, {q(r'[\s\-.()+]')}, '', 'g'), '[0-9][0-9]{{6,14}}'), lambda d: right(d, 10)))"


def blocking_tokens(x: str) -> str:
    return f"list_concat(list_filter(string_split({x}, ' '), lambda w: length(w) >= 2), {pieces(f'replace({x}, {q(' ')}, {q('')})', 3)})"


def country(x: str) -> str:
    return case(f"trim(regexp_replace(lower(trim({x})), {q('[^' + WORD_CHARS + r'\p{M}\s\p{Z}]')}, '', 'g'))", COUNTRY_FOLDS)


def fold_words(x: str, folds: dict[str, str]) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {case('w', folds)}), ' ')"


def drop_suffixes(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w NOT IN ({', '.join(map(q, LEGAL_SUFFIXES))})), ' ')"


CTES: dict[str, str] = {}


def _build() -> None:
    c = CTES
    c["l"] = "SELECT doc_id, coalesce(lang, '') AS lang, split_part(coalesce(text, ''), chr(10), 1) AS l1 FROM documents"
    c["rec"] = """SELECT CAST(CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 + 1 WHEN doc_id = min(doc_id) FILTER (doc_id % 3 = 0) OVER (PARTITION BY lower(l1)) THEN 1 ELSE doc_id // 3 % 2 + 2 END AS INT) AS src, lower(l1) AS k, 'S' || src || '-' || doc_id AS entity_id,
        array_to_string(list_slice(string_split(l1, ' '), 1, 5), ' ') AS name,
        length(l1) || ' ' || array_to_string(list_slice(string_split(l1, ' '), 6, 10), ' ') || ' Street ' || (10000 + length(l1) * 37 % 89999) AS address, lang AS raw_country
        FROM l"""
    c["dom"] = f"SELECT *, {domain('name')} AS dom, {clean('address')} AS cleaned FROM rec"
    c["prep0"] = f"SELECT *, {fold_words('dom', SUFFIX_FOLDS)} AS \"full\", {drop_suffixes('dom')} AS base, {fold_words('cleaned', STREET_FOLDS)} AS addr, {country('raw_country')} AS country FROM dom"
    c["prep"] = f"SELECT *, {numbers('address')} AS nums, {postals('address')} AS postals, {blocking_tokens('base')} AS tokens FROM prep0"
    c["s1"] = "SELECT * FROM prep WHERE src = 1"
    c["idx"] = "SELECT *, split_part(entity_id, '-', 1) AS s FROM prep WHERE src > 1"
    c["truth"] = "SELECT a.entity_id AS s1_id, list(b.entity_id) FILTER (WHERE b.entity_id IS NOT NULL) AS truth FROM rec a LEFT JOIN rec b ON a.k = b.k AND b.src > 1 WHERE a.src = 1 GROUP BY 1"
    c["true_pairs"] = "SELECT s1_id, unnest(truth) AS cand_id FROM truth"
    c["df"] = "SELECT s AS src, token, count(*) AS df FROM (SELECT s, entity_id, unnest(list_distinct(tokens)) AS token FROM idx) GROUP BY 1, 2"
    c["sizes"] = "SELECT s AS src, count(*) AS n, greatest(10, floor(count(*) * 0.03::DOUBLE))::BIGINT AS max_df FROM idx GROUP BY 1"
    c["idf"] = "SELECT df.src, token, df, ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1 AS idf FROM df JOIN sizes ON df.src = sizes.src WHERE df <= max_df"
    c["post"] = "SELECT i.src, i.token, p.entity_id AS cand_id, p.country AS cand_country, idf FROM (SELECT s, entity_id, country, unnest(list_distinct(tokens)) AS token FROM idx) p JOIN idf i ON i.src = p.s AND i.token = p.token"
    c["mine"] = "SELECT entity_id AS s1_id, country AS s1_country, token, count(*) AS times FROM (SELECT entity_id, country, unnest(tokens) AS token FROM s1) GROUP BY 1, 2, 3"
    c["name_hits"] = "SELECT s1_id, src, cand_id, times * idf AS score FROM mine JOIN post ON mine.token = post.token WHERE s1_country = '' OR cand_country = '' OR s1_country = cand_country"
    num = "SELECT {id} AS {id2}, {src} country, unnest(list_filter(list_distinct(list_concat(nums, postals)), lambda x: length(x) >= 4)) AS number FROM {t}"
    c["n1"] = num.format(id="entity_id", id2="s1_id", src="", t="s1")
    c["n2"] = num.format(id="entity_id", id2="cand_id", src="s AS src,", t="idx")
    c["number_hits"] = "SELECT s1_id, n2.src, cand_id, 3.0::DOUBLE AS score FROM n1 JOIN n2 ON n1.number = n2.number WHERE n1.country = '' OR n2.country = '' OR n1.country = n2.country"
    c["scores"] = "SELECT s1_id, src, cand_id, sum(score) AS score FROM (SELECT * FROM name_hits UNION ALL SELECT * FROM number_hits) GROUP BY 1, 2, 3"
    c["ranked"] = "SELECT *, row_number() OVER (PARTITION BY s1_id, src ORDER BY round(score, 9) DESC, cand_id) AS rank FROM scores WHERE round(score, 9) >= 1.5"
    c["top"] = "SELECT *, max(round(score, 9)) OVER (PARTITION BY s1_id, src) AS top FROM ranked WHERE rank <= 10"
    c["cand"] = "SELECT s1_id, cand_id, score FROM top WHERE round(score, 9) >= greatest(1.5, round(0.35::DOUBLE * top, 9))"
    forms = {
        "words": words("base"), "grams2": bigrams("base"), "abbrev": f"array_to_string(list_transform(list_sort({words('base')}), lambda w: substr(w, 1, 1)), '')", "first": "split_part(base, ' ', 1)",
        "full3": ngrams('"full"', 3), "full4": ngrams('"full"', 4), "suffix": suffix('"full"'), "addr_words": words("addr"), "addr3": ngrams("addr", 3), "addr4": ngrams("addr", 4),
        "street": f"nullif(regexp_extract(address, {q(NUMBER)}), '')", "sorted_full": sorted_words('"full"'), "sorted_addr": sorted_words("addr"),
    }
    c["forms"] = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in forms.items()) + " FROM prep"
    c["pairs"] = "SELECT s1_id, cand_id, a, b FROM cand JOIN forms a ON a.entity_id = s1_id JOIN forms b ON b.entity_id = cand_id"
    sets = "list_sort(list_intersect(string_split(a.\"full\", ' '), string_split(b.\"full\", ' ')))"
    less = "list_sort(list_filter(list_distinct(string_split({x}.\"full\", ' ')), lambda w: NOT list_contains(string_split({y}.\"full\", ' '), w)))"
    c["split"] = f"SELECT *, {sets} AS o, {less.format(x='a', y='b')} AS oa, {less.format(x='b', y='a')} AS ob FROM pairs"
    c["strings"] = "SELECT *, array_to_string(o, ' ') AS so, array_to_string(list_concat(o, oa), ' ') AS sa, array_to_string(list_concat(o, ob), ' ') AS sb, a.\"full\" AS fa, b.\"full\" AS fb, a.addr AS aa, b.addr AS ab, a.sorted_full AS wa, b.sorted_full AS wb, a.sorted_addr AS va, b.sorted_addr AS vb FROM split"
    c["ratios"] = f"""SELECT *, {ratio('fa', 'fb')} AS r_name, {ratio('aa', 'ab')} AS r_addr, {ratio('wa', 'wb')} AS r_name_sort, {ratio('va', 'vb')} AS r_addr_sort,
        CASE WHEN fa = '' OR fb = '' THEN 0.0 WHEN len(o) > 0 AND (len(oa) = 0 OR len(ob) = 0) THEN 1.0 WHEN len(o) = 0 THEN {ratio('sa', 'sb')} ELSE greatest({ratio('sa', 'sb')}, {ratio('so', 'sa')}, {ratio('so', 'sb')}) END AS r_name_set,
        CASE WHEN fa = '' OR fb = '' THEN 0.0 ELSE jaro_winkler_similarity(fa, fb) END AS r_jw FROM strings"""
    flag = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
    equal = lambda f: flag(f"a.{f} = b.{f} AND a.{f} <> ''")
    long_ = lambda s: f"list_filter({s}.addr_words, lambda w: length(w) >= 4)"
    base = {
        "name_exact_match": equal('"full"'), "name_base_exact_match": equal("base"), "name_fuzzy_ratio": "r_name", "name_token_sort_ratio": "r_name_sort", "name_token_set_ratio": "r_name_set", "name_jaro_winkler": "r_jw",
        "name_len_diff_ratio": "coalesce(abs(length(fa) - length(fb)) / nullif(greatest(length(fa), length(fb)), 0)::DOUBLE, 0.0)",
        "name_token_jaccard": jaccard("a.words", "b.words"), "name_char3_jaccard": jaccard("a.full3", "b.full3"), "name_bigram_jaccard": jaccard("a.grams2", "b.grams2"),
        "name_abbrev_match": equal("abbrev"), "name_first_token_exact": equal("first"), "addr_numeric_jaccard": jaccard("a.nums", "b.nums"), "addr_postal_jaccard": jaccard("a.postals", "b.postals"),
        "addr_token_sort_ratio": "r_addr_sort", "addr_fuzzy_ratio": "r_addr", "common_street_number_match": flag(f"{both('a.nums', 'b.nums')} > 0"), "addr_city_match": flag(f"{both(long_('a'), long_('b'))} > 0"),
        "name_missing": flag("fa = '' OR fb = ''"), "addr_missing": flag("aa = '' OR ab = ''"), "is_s2": flag("cand_id LIKE 'S2-%'"),
        "country_match": flag("a.country = '' OR b.country = '' OR a.country = b.country"), "name_emb_cosine": "0.0", "addr_emb_cosine": "0.0",
    }
    c["base_features"] = "SELECT s1_id, cand_id, " + ", ".join(f"({base[n]})::DOUBLE AS {n}" for n in BASE if n in base) + " FROM ratios"
    ca, cb = "lower(trim(a.raw_country))", "lower(trim(b.raw_country))"
    three = lambda known, same: f"CASE WHEN {known} THEN {flag(same)} ELSE 0.5 END"
    acc = {
        "baseline_prob": "0.5", "baseline_logit": "0.0", "name_exact_match": equal('"full"'), "name_base_exact_match": equal("base"), "name_levenshtein_sim": levenshtein("fa", "fb"), "name_base_levenshtein_sim": levenshtein("a.base", "b.base"),
        "name_token_jaccard": jaccard("a.words", "b.words"), "name_token_overlap_count": both("a.words", "b.words"), "name_token_overlap_ratio": overlap("a.words", "b.words"),
        "name_char3_jaccard": jaccard("a.full3", "b.full3"), "name_char4_jaccard": jaccard("a.full4", "b.full4"), "name_prefix_sim": prefix("a.base", "b.base"),
        "name_token_sort_ratio": "CASE WHEN fa <> '' AND fb <> '' THEN r_name_sort ELSE 0.0 END", "name_token_set_ratio": "r_name_set", "name_fuzzy_ratio": "CASE WHEN fa <> '' AND fb <> '' THEN r_name ELSE 0.0 END",
        "name_is_substring": flag("length(fa) >= 3 AND length(fb) >= 3 AND (contains(fa, fb) OR contains(fb, fa))"), "name_len_diff": "abs(length(fa) - length(fb))",
        "name_len_ratio": "coalesce(least(length(fa), length(fb)) / nullif(greatest(length(fa), length(fb)), 0)::DOUBLE, 0.0)", "name_tfidf_cosine": jaccard("a.words", "b.words"),
        "name_legal_suffix_match": three("a.suffix IS NOT NULL AND b.suffix IS NOT NULL", "a.suffix = b.suffix"), "name_has_suffix_a": flag("a.suffix IS NOT NULL"), "name_has_suffix_b": flag("b.suffix IS NOT NULL"),
        "name_missing": flag("fa = '' OR fb = ''"), "addr_exact_match": equal("addr"), "addr_levenshtein_sim": levenshtein("aa", "ab"), "addr_token_jaccard": jaccard("a.addr_words", "b.addr_words"),
        "addr_token_overlap_count": both("a.addr_words", "b.addr_words"), "addr_token_overlap_ratio": overlap("a.addr_words", "b.addr_words"), "addr_char3_jaccard": jaccard("a.addr3", "b.addr3"), "addr_char4_jaccard": jaccard("a.addr4", "b.addr4"),
        "addr_tfidf_cosine": jaccard("a.addr_words", "b.addr_words"), "addr_postal_exact_match": three("len(a.postals) > 0 AND len(b.postals) > 0", f"{both('a.postals', 'b.postals')} > 0"), "addr_postal_jaccard": jaccard("a.postals", "b.postals"),
        "addr_postal_overlap_count": both("a.postals", "b.postals"), "addr_has_postal_a": flag("len(a.postals) > 0"), "addr_has_postal_b": flag("len(b.postals) > 0"),
        "addr_street_num_match": three("a.street IS NOT NULL AND b.street IS NOT NULL", "a.street = b.street"), "addr_numeric_jaccard": jaccard("a.nums", "b.nums"), "addr_numeric_overlap_count": both("a.nums", "b.nums"),
        "addr_fuzzy_ratio": "CASE WHEN aa <> '' AND ab <> '' THEN r_addr ELSE 0.0 END", "addr_token_sort_ratio": "CASE WHEN aa <> '' AND ab <> '' THEN r_addr_sort ELSE 0.0 END", "addr_missing": flag("aa = '' OR ab = ''"),
        "country_exact_match": three(f"{ca} <> '' AND {cb} <> ''", f"{ca} = {cb}"), "country_conflict": flag(f"{ca} <> '' AND {cb} <> '' AND {ca} <> {cb}"), "is_s2": flag("cand_id LIKE 'S2-%'"), "is_s3": flag("cand_id LIKE 'S3-%'"),
        "name_a_missing": flag("fa = ''"), "name_b_missing": flag("fb = ''"), "addr_a_missing": flag("aa = ''"), "addr_b_missing": flag("ab = ''"), "either_addr_missing": flag("aa = '' OR ab = ''"), "both_addr_present": flag("aa <> '' AND ab <> ''"),
    }
    c["acc0"] = "SELECT s1_id, cand_id, " + ", ".join(f"({v})::DOUBLE AS {n}" for n, v in acc.items()) + " FROM ratios"
    c["acc1"] = "SELECT *, name_levenshtein_sim AS ns, CASE WHEN both_addr_present = 1 THEN addr_levenshtein_sim ELSE name_levenshtein_sim END AS es FROM acc0"
    last = {"name_addr_mean_sim": "0.6::DOUBLE * ns + 0.4::DOUBLE * es", "name_addr_geom_sim": "sqrt(ns * es)", "name_addr_min_sim": "least(ns, es)", "name_addr_sim_diff": "abs(ns - es)", "name_addr_prod_sim": "ns * es"}
    c["acc_features"] = "SELECT s1_id, cand_id, " + ", ".join(n if n in acc else f"({last[n]})::DOUBLE AS {n}" for n in ACCURACY if n in acc or n in last) + " FROM acc1"
    c["scored"] = "SELECT s1_id, cand_id, 0.6::DOUBLE * name_base_levenshtein_sim + 0.4::DOUBLE * addr_token_jaccard AS score, f.* EXCLUDE (s1_id, cand_id) FROM acc_features f"
    c["blends"] = "SELECT *, score AS ml_prob, 0.4::DOUBLE * baseline_prob + 0.6::DOUBLE * score AS ml, 0.50::DOUBLE * baseline_prob + 0.30::DOUBLE * score + 0.12::DOUBLE * ((name_base_levenshtein_sim + name_token_jaccard) * 0.5::DOUBLE) + 0.08::DOUBLE * ((addr_levenshtein_sim + addr_token_jaccard) * 0.5::DOUBLE) AS ensemble FROM scored"
    c["guard0"] = "SELECT *, greatest(name_exact_match, name_base_exact_match, name_levenshtein_sim, name_base_levenshtein_sim, name_token_jaccard, name_is_substring * 0.7::DOUBLE) AS gn, greatest(addr_exact_match, addr_levenshtein_sim, addr_token_jaccard, least(1.0::DOUBLE, addr_numeric_overlap_count)) AS ga, name_exact_match > 0.5 OR name_base_exact_match > 0.5 AS ex FROM blends"
    c["guards"] = "SELECT *, CASE WHEN country_conflict > 0.5 OR (gn < 0.35::DOUBLE AND ga < 0.35::DOUBLE) THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ml * CASE WHEN addr_has_postal_a > 0.5 AND addr_has_postal_b > 0.5 AND addr_postal_exact_match < 0.2 AND NOT ex THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN addr_street_num_match < 0.2 AND NOT ex AND ga < 0.60::DOUBLE THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END)) END AS guarded FROM guard0"
    c["tops"] = "SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM scored"
    c["matches"] = "SELECT s1_id, cand_id, score FROM tops WHERE top >= 0.6::DOUBLE AND score >= 0.6::DOUBLE AND top - score <= 0.11::DOUBLE"
    c["matches2"] = "SELECT s1_id, cand_id, score FROM tops WHERE top >= 0.65::DOUBLE AND score >= 0.55::DOUBLE AND (score >= top - 0.12::DOUBLE OR score >= 0.7::DOUBLE)"
    c["counts"] = "SELECT t.s1_id, coalesce(len(t.truth), 0) AS n_true, count(m.cand_id) AS n_pred, count(p.cand_id) AS tp FROM truth t LEFT JOIN matches m ON m.s1_id = t.s1_id LEFT JOIN true_pairs p ON p.s1_id = m.s1_id AND p.cand_id = m.cand_id GROUP BY t.s1_id, t.truth"
    c["grid2"] = "SELECT round(0.30 + 0.02 * i, 2)::DOUBLE AS threshold, round(0.05 + 0.02 * j, 2)::DOUBLE AS margin FROM range(29) a(i), range(8) b(j)"
    c["grid3"] = "SELECT round(0.35 + 0.05 * i, 2)::DOUBLE AS threshold, round(0.45 + 0.05 * j, 2)::DOUBLE AS hurdle, m::DOUBLE AS margin FROM range(13) a(i), range(7) b(j), (VALUES (0.10), (0.12), (0.15)) c(m)"
    c["lab"] = "SELECT tops.*, p.cand_id IS NOT NULL AS t FROM tops LEFT JOIN true_pairs p ON p.s1_id = tops.s1_id AND p.cand_id = tops.cand_id"
    count = "SELECT g.*, t.s1_id, coalesce(len(any_value(t.truth)), 0) AS n_true, count(l.cand_id) AS n_pred, count(l.cand_id) FILTER (WHERE l.t) AS tp FROM truth t CROSS JOIN {g} g LEFT JOIN lab l ON l.s1_id = t.s1_id AND {keep} GROUP BY ALL"
    c["counts2"] = count.format(g="grid2", keep="l.top >= g.threshold AND l.score >= g.threshold AND l.top - l.score <= g.margin")
    c["counts3"] = count.format(g="grid3", keep="l.top >= g.hurdle AND l.score >= g.threshold AND (l.score >= l.top - g.margin OR l.score >= 0.7::DOUBLE)")
    for kind, text in (("name", "base"), ("addr", "addr")):
        padded = "' ' || w || ' '"
        grams = f"flatten(list_transform(string_split(CASE WHEN {text} = '' THEN 'empty' ELSE {text} END, ' '), lambda w: CASE WHEN length(w) <= 1 THEN [{padded}] ELSE list_concat({pieces(f'({padded})', 3)}, {pieces(f'({padded})', 4)}) END))"
        c[f"{kind}_grams"] = f"SELECT entity_id, {grams} AS grams FROM prep"
        c[f"{kind}_idf"] = f"SELECT gram, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM prep)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM (SELECT entity_id, unnest(list_distinct(grams)) AS gram FROM {kind}_grams) GROUP BY 1 HAVING count(*) >= 2"
        c[f"{kind}_raw"] = f"SELECT entity_id, g.gram, (1 + ln(count(*)::DOUBLE)) * any_value(idf) AS w FROM (SELECT entity_id, unnest(grams) AS gram FROM {kind}_grams) g JOIN {kind}_idf i ON i.gram = g.gram GROUP BY 1, 2"
        c[f"{kind}_vec"] = f"SELECT entity_id AS id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id)) AS weight FROM {kind}_raw"


_build()


def score_of(n_true: str = "n_true", n_pred: str = "n_pred", tp: str = "tp") -> str:
    return f"CASE WHEN {n_true} = 0 AND {n_pred} = 0 THEN 1.0 WHEN {n_true} = 0 OR {n_pred} = 0 THEN 0.0 ELSE 1.25::DOUBLE * {tp} / (0.25::DOUBLE * {n_true} + {n_pred}) END"


def figures() -> str:
    return f"""round(avg({score_of()}), 6) AS macro_f0_5, round(coalesce(avg(CASE WHEN n_pred > 0 THEN tp / n_pred::DOUBLE END), 1.0), 6) AS macro_precision,
        round(coalesce(avg(CASE WHEN n_true > 0 THEN tp / n_true::DOUBLE END), 0.0), 6) AS macro_recall, count(*) AS n_entities, sum(n_pred)::BIGINT AS n_predicted_matches, sum(tp)::BIGINT AS n_tp,
        sum(n_pred - tp)::BIGINT AS n_fp, sum(n_true - tp)::BIGINT AS n_fn, count(*) FILTER (WHERE n_true = 0) AS n_singletons, count(*) FILTER (WHERE n_true > 0) AS n_with_matches,
        count(*) FILTER (WHERE n_true = 0 AND n_pred = 0) AS n_correct_singletons, count(*) FILTER (WHERE n_true = 0 AND n_pred > 0) AS n_false_merge_singletons"""


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def sql(select: str) -> str:
    """The select with the expressions that it needs, in order."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name])
                needed.append(name)

    need(select)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" if needed else "") + select
