"""Pair features as columns over the structs a and b of a pair; all doubles."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _both(name: str) -> tuple[Column, Column]:
    return F.col(f"a.{name}"), F.col(f"b.{name}")


def _equal(name: str) -> Column:
    a, b = _both(name)
    return _flag((a == b) & (a != ""))


#: The names of the baseline features, in order.
BASE = """
name_exact_match name_base_exact_match name_fuzzy_ratio name_partial_ratio name_token_sort_ratio name_token_set_ratio name_jaro_winkler
name_len_diff_ratio name_token_jaccard name_char3_jaccard name_bigram_jaccard name_abbrev_match name_first_token_exact
addr_numeric_jaccard addr_postal_jaccard addr_token_sort_ratio addr_fuzzy_ratio common_street_number_match addr_city_match
name_missing addr_missing is_s2 country_match name_emb_cosine addr_emb_cosine
""".split()


def with_ratios(pairs: DataFrame) -> DataFrame:
    """pairs with structs name_r and addr_r of edit ratios: the one step in Python, shared by both feature sets."""
    return pairs.withColumns({"name_r": S.edit_ratios(F.col("a.full"), F.col("b.full")), "addr_r": S.edit_ratios(F.col("a.addr"), F.col("b.addr"), ("ratio", "token_sort_ratio"))})


def base_features(pairs: DataFrame) -> DataFrame:
    """s1_id, cand_id and the baseline features of pairs from with_ratios. Embedding cosines are 0 unless the records have vectors."""
    (fa, fb), (na, nb), (ca, cb) = _both("full"), _both("nums"), _both("country")
    long_words = lambda side: F.filter(F.col(f"{side}.addr_words"), lambda w: F.length(w) >= 4)
    vectors = {f[0] for f in pairs.select("a.*").dtypes}
    out = {
        "name_exact_match": _equal("full"), "name_base_exact_match": _equal("base"),
        "name_fuzzy_ratio": F.col("name_r.ratio"), "name_partial_ratio": F.col("name_r.partial_ratio"), "name_token_sort_ratio": F.col("name_r.token_sort_ratio"),
        "name_token_set_ratio": F.col("name_r.token_set_ratio"), "name_jaro_winkler": F.col("name_r.jaro_winkler"),
        "name_len_diff_ratio": S.length_difference(fa, fb), "name_token_jaccard": S.jaccard(*_both("words")), "name_char3_jaccard": S.jaccard(*_both("full3")),
        "name_bigram_jaccard": S.jaccard(*_both("bigrams")), "name_abbrev_match": _equal("abbrev"), "name_first_token_exact": _equal("first"),
        "addr_numeric_jaccard": S.jaccard(na, nb), "addr_postal_jaccard": S.jaccard(*_both("postals")),
        "addr_token_sort_ratio": F.col("addr_r.token_sort_ratio"), "addr_fuzzy_ratio": F.col("addr_r.ratio"),
        "common_street_number_match": _flag(F.arrays_overlap(na, nb)), "addr_city_match": _flag(F.arrays_overlap(long_words("a"), long_words("b"))),
        "name_missing": _flag((fa == "") | (fb == "")), "addr_missing": _flag((F.col("a.addr") == "") | (F.col("b.addr") == "")),
        "is_s2": _flag(F.startswith("cand_id", F.lit("S2-"))), "country_match": _flag((ca == "") | (cb == "") | (ca == cb)),
        "name_emb_cosine": S.cosine(*_both("name_vector")) if "name_vector" in vectors else F.lit(0.0), "addr_emb_cosine": S.cosine(*_both("addr_vector")) if "addr_vector" in vectors else F.lit(0.0),
    }
    return pairs.select("s1_id", "cand_id", *[out[name].alias(name) for name in BASE])


#: The names of the accuracy features, in order.
ACCURACY = """
baseline_prob baseline_logit name_exact_match name_base_exact_match name_levenshtein_sim name_base_levenshtein_sim
name_token_jaccard name_token_overlap_count name_token_overlap_ratio name_char3_jaccard name_char4_jaccard name_prefix_sim
name_token_sort_ratio name_token_set_ratio name_fuzzy_ratio name_partial_ratio name_is_substring name_len_diff name_len_ratio
name_tfidf_cosine name_legal_suffix_match name_has_suffix_a name_has_suffix_b name_missing
addr_exact_match addr_levenshtein_sim addr_token_jaccard addr_token_overlap_count addr_token_overlap_ratio addr_char3_jaccard addr_char4_jaccard addr_tfidf_cosine
addr_postal_exact_match addr_postal_jaccard addr_postal_overlap_count addr_has_postal_a addr_has_postal_b
addr_street_num_match addr_numeric_jaccard addr_numeric_overlap_count addr_fuzzy_ratio addr_token_sort_ratio addr_missing
country_exact_match country_conflict is_s2 is_s3
name_addr_mean_sim name_addr_geom_sim name_addr_min_sim name_addr_sim_diff name_addr_prod_sim
name_a_missing name_b_missing addr_a_missing addr_b_missing either_addr_missing both_addr_present
""".split()

#: The forms of records (prepare.with_forms) that accuracy features read; those that aren't here read none.
FORMS = {
    **dict.fromkeys(["name_token_jaccard", "name_token_overlap_count", "name_token_overlap_ratio", "name_tfidf_cosine"], "words"),
    **dict.fromkeys(["addr_token_jaccard", "addr_token_overlap_count", "addr_token_overlap_ratio", "addr_tfidf_cosine"], "addr_words"),
    **dict.fromkeys(["name_legal_suffix_match", "name_has_suffix_a", "name_has_suffix_b"], "suffix"), "addr_street_num_match": "street",
    "name_char3_jaccard": "full3", "name_char4_jaccard": "full4", "addr_char3_jaccard": "addr3", "addr_char4_jaccard": "addr4",
    **dict.fromkeys(["addr_postal_exact_match", "addr_postal_jaccard", "addr_postal_overlap_count", "addr_has_postal_a", "addr_has_postal_b"], "postals"),
    **dict.fromkeys(["addr_numeric_jaccard", "addr_numeric_overlap_count"], "nums"),
}

#: The fields of records that forms are made of, and the features that read fields themselves or by a form.
SOURCES = {"words": "base", "addr_words": "addr", "suffix": "full", "street": "address", "full3": "full", "full4": "full", "addr3": "addr", "addr4": "addr", "postals": "address", "nums": "address"}
READ = {
    "full": "name_exact_match name_levenshtein_sim name_token_sort_ratio name_token_set_ratio name_fuzzy_ratio name_partial_ratio name_is_substring name_len_diff name_len_ratio name_missing name_a_missing name_b_missing",
    "base": "name_base_exact_match name_base_levenshtein_sim name_prefix_sim",
    "addr": "addr_exact_match addr_levenshtein_sim addr_fuzzy_ratio addr_token_sort_ratio addr_missing addr_a_missing addr_b_missing either_addr_missing both_addr_present",
    "raw_country": "country_exact_match country_conflict",
}
MEANS = ("name_addr_mean_sim", "name_addr_geom_sim", "name_addr_min_sim", "name_addr_sim_diff", "name_addr_prod_sim")


def fields_of(names: Collection[str]) -> set[str]:
    """The fields of records (prepare.prepare) that the named accuracy features and their forms read."""
    read = {field for field, of in READ.items() if {*of.split()} & {*names}} | {SOURCES[FORMS[n]] for n in names if n in FORMS}
    return read | ({"full", "addr"} if {*MEANS} & {*names} else set())


def _three(known: Column, same: Column) -> Column:
    """1 or 0 where both sides are known, else 0.5."""
    return F.when(known, same.cast("double")).otherwise(0.5)


def accuracy_features(pairs: DataFrame, only: Sequence[str] = ACCURACY) -> DataFrame:
    """s1_id, cand_id and the accuracy features, or those named by only, of pairs from with_ratios.

    baseline_prob (0.5), name_tfidf_cosine and addr_tfidf_cosine (token Jaccards) stand in
    with the values in brackets where pairs has no column of that name.
    """
    (fa, fb), (ba, bb), (aa, ab) = _both("full"), _both("base"), _both("addr")
    (pa, pb), (na, nb), (wa, wb), (va, vb), (sa, sb), (ta, tb) = (_both(x) for x in ("postals", "nums", "words", "addr_words", "suffix", "street"))
    ca, cb = (F.lower(F.trim(c)) for c in _both("raw_country"))
    known = (ca != "") & (cb != "")
    names, addresses = (fa != "") & (fb != ""), (aa != "") & (ab != "")
    if_names = lambda c: F.when(names, c).otherwise(0.0)
    if_addresses = lambda c: F.when(addresses, c).otherwise(0.0)
    prob = F.coalesce(F.col("baseline_prob"), F.lit(0.5)) if "baseline_prob" in pairs.columns else F.lit(0.5)
    has_postals = (F.size(pa) > 0) & (F.size(pb) > 0)
    first = {
        "baseline_prob": prob, "baseline_logit": S.clamped_logit(prob), "name_exact_match": _equal("full"), "name_base_exact_match": _equal("base"),
        "name_levenshtein_sim": S.levenshtein(fa, fb), "name_base_levenshtein_sim": S.levenshtein(ba, bb),
        "name_token_jaccard": S.jaccard(wa, wb), "name_token_overlap_count": S.shared(wa, wb), "name_token_overlap_ratio": S.overlap(wa, wb),
        "name_char3_jaccard": S.jaccard(*_both("full3")), "name_char4_jaccard": S.jaccard(*_both("full4")), "name_prefix_sim": S.prefix_ratio(ba, bb),
        "name_token_sort_ratio": if_names(F.col("name_r.token_sort_ratio")), "name_token_set_ratio": if_names(F.col("name_r.token_set_ratio")),
        "name_fuzzy_ratio": if_names(F.col("name_r.ratio")), "name_partial_ratio": if_names(F.col("name_r.partial_ratio")),
        "name_is_substring": S.is_substring(fa, fb), "name_len_diff": F.abs(F.length(fa) - F.length(fb)).cast("double"), "name_len_ratio": S.length_ratio(fa, fb),
        "name_legal_suffix_match": _three(sa.isNotNull() & sb.isNotNull(), sa == sb), "name_has_suffix_a": _flag(sa.isNotNull()), "name_has_suffix_b": _flag(sb.isNotNull()),
        "name_missing": _flag(~names), "addr_exact_match": _equal("addr"), "addr_levenshtein_sim": S.levenshtein(aa, ab),
        "addr_token_jaccard": S.jaccard(va, vb), "addr_token_overlap_count": S.shared(va, vb), "addr_token_overlap_ratio": S.overlap(va, vb),
        "addr_char3_jaccard": S.jaccard(*_both("addr3")), "addr_char4_jaccard": S.jaccard(*_both("addr4")),
        "addr_postal_exact_match": _three(has_postals, F.arrays_overlap(pa, pb)), "addr_postal_jaccard": S.jaccard(pa, pb), "addr_postal_overlap_count": S.shared(pa, pb),
        "addr_has_postal_a": _flag(F.size(pa) > 0), "addr_has_postal_b": _flag(F.size(pb) > 0), "addr_street_num_match": _three(ta.isNotNull() & tb.isNotNull(), ta == tb),
        "addr_numeric_jaccard": S.jaccard(na, nb), "addr_numeric_overlap_count": S.shared(na, nb),
        "addr_fuzzy_ratio": if_addresses(F.col("addr_r.ratio")), "addr_token_sort_ratio": if_addresses(F.col("addr_r.token_sort_ratio")), "addr_missing": _flag(~addresses),
        "country_exact_match": _three(known, ca == cb), "country_conflict": _flag(known & (ca != cb)),
        "is_s2": _flag(F.startswith("cand_id", F.lit("S2-"))), "is_s3": _flag(F.startswith("cand_id", F.lit("S3-"))),
        "name_a_missing": _flag(fa == ""), "name_b_missing": _flag(fb == ""), "addr_a_missing": _flag(aa == ""), "addr_b_missing": _flag(ab == ""),
        "either_addr_missing": _flag(~addresses), "both_addr_present": _flag(addresses),
    }
    for kind in ("name", "addr"):
        column = f"{kind}_tfidf_cosine"
        first[column] = F.coalesce(F.col(column), F.lit(0.0)) if column in pairs.columns else first[f"{kind}_token_jaccard"]
    used = {*only, *(("name_levenshtein_sim", "addr_levenshtein_sim", "both_addr_present") if {*only} - {*first} else ())}
    base = pairs.select("s1_id", "cand_id", *[c.alias(n) for n, c in first.items() if n in used])
    name, addr = F.col("name_levenshtein_sim"), F.when(F.col("both_addr_present") == 1, F.col("addr_levenshtein_sim")).otherwise(F.col("name_levenshtein_sim"))
    last = {"name_addr_mean_sim": 0.6 * name + 0.4 * addr, "name_addr_geom_sim": F.sqrt(name * addr), "name_addr_min_sim": F.least(name, addr), "name_addr_sim_diff": F.abs(name - addr), "name_addr_prod_sim": name * addr}
    return base.withColumns({n: c for n, c in last.items() if n in used}).select("s1_id", "cand_id", *only)
