"""The queries of the record-linkage engine, each with the SQL that gives the same rows.

They run over organisation records derived from `documents` (sources.views), `embeddings`
and `pages`. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as N
from ..functions import tokens as T
from ..operators import blocking as B
from ..operators import decide as D
from ..operators import metrics as M
from ..operators import pairs as C
from ..operators import tfidf as V
from ..operators import validate as Q
from ..operators.features import ACCURACY, BASE, FORMS, accuracy_features, base_features, fields_of, with_ratios
from ..operators.prepare import prepare, with_forms
from ..operators.store import spread, stored
from ..sources import tsv
from ..sources import views as R
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = O.sql(oracle)
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def joined(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), "|")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(R.records(spark, sf_dir))


class Run:
    """The tables that one query builds on, each made and stored at most once. columns: those of the records that it reads, all if none are named."""

    def __init__(self, spark: SparkSession, sf_dir: str, *columns: str):
        self.spark, self.sf_dir, self.columns = spark, sf_dir, columns

    @cached_property
    def records(self) -> DataFrame:
        return stored(prepare(R.records(self.spark, self.sf_dir)).select(*self.columns or "*"))

    @property
    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Reference records, and the records of both other sources."""
        return self.records.filter(c("entity_id").startswith("S1-")), self.records.filter(~c("entity_id").startswith("S1-"))

    @cached_property
    def found(self) -> DataFrame:
        return stored(spread(B.candidates(*self.sides)))

    @property
    def pairs(self) -> DataFrame:
        return self.pairs_with(None)

    def pairs_with(self, forms: Collection[str] | None, fields: Collection[str] | None = None) -> DataFrame:
        """Candidate pairs with both records, or the named fields of them, and the named forms, or all."""
        a, b = self.sides
        return C.each_side(C.join_records(self.found, a.drop("tokens"), b.drop("tokens"), fields), lambda side: with_forms(side, forms))

    def pairs_for(self, names: Collection[str]) -> DataFrame:
        """Candidate pairs with just what the named accuracy features read."""
        return self.pairs_with(forms_of(names), fields_of(names))

    def scored(self, *names: str) -> DataFrame:
        """The named accuracy features and a closed-form score: no model, so that SQL has the same. Each query reads it once, so it isn't stored."""
        names = [n for n in ACCURACY if n in {*names, "name_base_levenshtein_sim", "addr_token_jaccard"}]
        return accuracy_features(without_ratios(self.pairs_for(names)), names).withColumn("score", 0.6 * F.col("name_base_levenshtein_sim") + 0.4 * F.col("addr_token_jaccard"))

    @property
    def matches(self) -> DataFrame:
        return D.decide(self.scored(), 0.6, 0.11)


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return Run(spark, sf_dir).sides


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that nothing else of the query reads: not stored."""
    return B.candidates(*sides(spark, sf_dir))


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Run(spark, sf_dir).pairs


def scored(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return Run(spark, sf_dir).scored(*names)


def forms_of(names: Collection[str]) -> set[str]:
    return {FORMS[n] for n in names if n in FORMS}


def without_ratios(pairs: DataFrame) -> DataFrame:
    """For features that read no edit ratio: none is computed."""
    none = F.struct(*[F.lit(0.0).alias(n) for n in S.RATIOS])
    return pairs.withColumns({"name_r": none, "addr_r": none})


def _scalar(name: str, made: Callable[[], Column], sql_value: str, table: str = "prep") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return records(spark, sf_dir).select("entity_id", made().alias("value"))

    run.__name__ = name
    query(f"SELECT entity_id, {sql_value} AS value FROM {table}")(run)


c = F.col
_scalar("clean_text", lambda: N.basic_clean(c("name")), O.clean("name"))
_scalar("norm_country", lambda: c("country"), "country")
_scalar("norm_name", lambda: c("full"), '"full"')
_scalar("base_name", lambda: c("base"), "base")
_scalar("norm_address", lambda: c("addr"), "addr")
_scalar("name_tokens", lambda: joined(T.words(c("base"))), O.joined(O.words("base")))
_scalar("name_bigrams", lambda: joined(T.name_bigrams(c("base"))), O.joined(O.bigrams("base")))
_scalar("name_abbrev", lambda: T.name_abbreviation(c("base")), f"array_to_string(list_transform(list_sort({O.words('base')}), lambda w: substr(w, 1, 1)), '')")
_scalar("first_token", lambda: T.first_word(c("base")), "split_part(base, ' ', 1)")
_scalar("addr_tokens", lambda: joined(T.words(c("addr"))), O.joined(O.words("addr")))
_scalar("numeric_tokens", lambda: joined(c("nums")), O.joined("nums"))
_scalar("postal_tokens", lambda: joined(c("postals")), O.joined("postals"))
_scalar("phone_tokens", lambda: joined(T.phone_tokens(c("address"))), O.joined(O.phones("address")))
_scalar("block_tokens", lambda: joined(c("tokens")), O.joined("tokens"))
_scalar("block_addr_tokens", lambda: joined(T.words(c("addr"), 3)), O.joined(O.words("addr", 3)))
_scalar("char_ngrams", lambda: joined(T.char_ngrams(c("full"), 3)), O.joined(O.ngrams('"full"', 3)))
_scalar("legal_suffix", lambda: F.coalesce(T.legal_suffix(c("full")), F.lit("")), f"coalesce({O.suffix(chr(34) + 'full' + chr(34))}, '')")
_scalar("street_number", lambda: F.coalesce(T.street_number(c("address")), F.lit("")), f"coalesce(nullif(regexp_extract(address, {O.q(O.NUMBER)}), ''), '')")
_scalar("entity_split", lambda: C.md5_fold(c("entity_id"), 5), "CAST(list_sum(list_transform(string_split(md5(entity_id), ''), lambda x: position(x IN '0123456789abcdef') - 1)) % 5 AS INT)")


@query(f"SELECT page_id, {O.domain('url')} AS value FROM pages")
def clean_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", N.clean_domain_name(c("url")).alias("value"))


@query("SELECT src, token, df FROM df")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.document_frequency(sides(spark, sf_dir)[1])


@query("SELECT df.src, token, df FROM df JOIN sizes ON df.src = sizes.src WHERE df > max_df")
def stop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sides(spark, sf_dir)[1]
    return B.document_frequency(b).join(B.source_sizes(b), "src").filter("df > max_df").select("src", "token", "df")


@query("SELECT src, token, cand_id, round(idf, 6) AS idf FROM post")
def idf_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.postings(sides(spark, sf_dir)[1]).select("src", "token", "cand_id", "idf"))


@query("SELECT s1_id, cand_id, round(sum(score), 6) AS score FROM name_hits GROUP BY 1, 2")
def block_name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.name_scores(*Run(spark, sf_dir, "entity_id", "country", "tokens").sides))


@query("SELECT s1_id, cand_id, sum(score) AS score FROM number_hits GROUP BY 1, 2")
def block_numeric_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.number_hits(*sides(spark, sf_dir)).groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score"))


@query("SELECT s1_id, cand_id, round(score, 6) AS score FROM cand")
def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(found(spark, sf_dir))


@query("SELECT split_part(cand_id, '-', 1) AS src, count(*) AS n_pairs, count(DISTINCT s1_id) AS n_entities FROM cand GROUP BY 1")
def block_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources blocked each for itself, with its own sizes, then put together."""
    a, b = sides(spark, sf_dir)
    both = B.candidates(a, b.filter(c("entity_id").startswith("S2-"))).unionByName(B.candidates(a, b.filter(c("entity_id").startswith("S3-"))))
    return both.groupBy(B.source_of(c("cand_id")).alias("src")).agg(F.count("*").alias("n_pairs"), F.countDistinct("s1_id").alias("n_entities"))


@query("""SELECT round(coalesce(f / nullif(t, 0)::DOUBLE, 1.0), 6) AS recall, round(total / e::DOUBLE, 6) AS avg_candidates, total AS total_candidates, t AS true_pairs, f AS found_pairs
    FROM (SELECT (SELECT count(*) FROM true_pairs) AS t, (SELECT count(*) FROM true_pairs p JOIN cand ON cand.s1_id = p.s1_id AND cand.cand_id = p.cand_id) AS f, (SELECT count(*) FROM truth) AS e, (SELECT count(*) FROM cand) AS total)""")
def block_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.recall(found(spark, sf_dir), R.truth(spark, sf_dir)))


@query("SELECT cand.s1_id, cand.cand_id, CASE WHEN p.cand_id IS NULL THEN 0 ELSE 1 END AS label FROM cand LEFT JOIN true_pairs p ON p.s1_id = cand.s1_id AND p.cand_id = cand.cand_id")
def pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label(found(spark, sf_dir), R.truth(spark, sf_dir)).select("s1_id", "cand_id", "label")


LABELLED = "(SELECT CASE WHEN p.cand_id IS NULL THEN 0 ELSE 1 END AS label, count(*) AS n FROM cand LEFT JOIN true_pairs p ON p.s1_id = cand.s1_id AND p.cand_id = cand.cand_id GROUP BY 1)"


@query(f"SELECT label, CASE WHEN label = 1 THEN n ELSE least(n, 6 * (SELECT n FROM {LABELLED} WHERE label = 1)) END AS n FROM {LABELLED}")
def negative_cap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = C.label(found(spark, sf_dir), R.truth(spark, sf_dir))
    return C.cap_negatives(labelled).groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT label, n, round((sum(n) OVER ()) / (2 * n)::DOUBLE, 6) AS weight FROM {LABELLED}")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.class_weights(C.label(found(spark, sf_dir), R.truth(spark, sf_dir))))


def _pairwise(name: str, made: Callable[[Column, Column], Column], sql_value: str, table: str = "pairs") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(candidate_pairs(spark, sf_dir).select("s1_id", "cand_id", made(F.col("a"), F.col("b")).alias("value")))

    run.__name__ = name
    query(f"SELECT s1_id, cand_id, round(({sql_value})::DOUBLE, 6) AS value FROM {table}")(run)


_pairwise("sim_jaccard", lambda a, b: S.jaccard(a["words"], b["words"]), O.jaccard("a.words", "b.words"))
_pairwise("sim_overlap", lambda a, b: S.overlap(a["words"], b["words"]), O.overlap("a.words", "b.words"))
_pairwise("sim_prefix", lambda a, b: S.prefix_ratio(a["base"], b["base"]), O.prefix("a.base", "b.base"))
_pairwise("sim_levenshtein", lambda a, b: S.levenshtein(a["full"], b["full"]), O.levenshtein('a."full"', 'b."full"'))
_pairwise("sim_lengths", lambda a, b: S.length_difference(a["full"], b["full"]), 'coalesce(abs(length(a."full") - length(b."full")) / nullif(greatest(length(a."full"), length(b."full")), 0)::DOUBLE, 0.0)')
_pairwise("sim_substring", lambda a, b: S.is_substring(a["full"], b["full"]), 'CASE WHEN length(a."full") >= 3 AND length(b."full") >= 3 AND (contains(a."full", b."full") OR contains(b."full", a."full")) THEN 1.0 ELSE 0.0 END')
_pairwise("sim_indel", lambda a, b: S.edit_ratios(a["full"], b["full"], ("ratio",))["ratio"], "r_name", "ratios")
_pairwise("sim_indel_native", lambda a, b: F.coalesce(S.indel_ratio(a["full"], b["full"]), F.lit(-1.0)), "CASE WHEN least(length(fa), length(fb)) <= 61 THEN r_name ELSE -1.0 END", "ratios")
_pairwise("sim_token_sort", lambda a, b: S.edit_ratios(a["full"], b["full"], ("token_sort_ratio",))["token_sort_ratio"], "r_name_sort", "ratios")
_pairwise("sim_token_set", lambda a, b: S.edit_ratios(a["full"], b["full"], ("token_set_ratio",))["token_set_ratio"], "r_name_set", "ratios")
_pairwise("sim_jaro_winkler", lambda a, b: S.edit_ratios(a["full"], b["full"], ("jaro_winkler",))["jaro_winkler"], "r_jw", "ratios")


@query()
def sim_partial_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no window of a window here; tests hold it against a plain loop."""
    return rounded(candidate_pairs(spark, sf_dir).select("s1_id", "cand_id", S.edit_ratios(c("a.full"), c("b.full"), ("partial_ratio",))["partial_ratio"].alias("value")))


@query("SELECT s1_id, cand_id, round(least(10.0::DOUBLE, greatest(-10.0::DOUBLE, ln(p / (1 - p)))), 6) AS value FROM (SELECT s1_id, cand_id, least(1 - 1e-5::DOUBLE, greatest(1e-5::DOUBLE, score)) AS p FROM scored)")
def sim_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("s1_id", "cand_id", S.clamped_logit(c("score")).alias("value")))


BASE_CHECKED = [n for n in BASE if n != "name_partial_ratio"]
ACCURACY_CHECKED = [n for n in ACCURACY if n != "name_partial_ratio"]


@query(f"SELECT s1_id, cand_id, {O.rounded(BASE_CHECKED)} FROM base_features")
def features_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base_features(with_ratios(candidate_pairs(spark, sf_dir))).select("s1_id", "cand_id", *BASE_CHECKED))


@query(f"SELECT s1_id, cand_id, {O.rounded(ACCURACY_CHECKED)} FROM acc_features")
def features_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_ratios(Run(spark, sf_dir).pairs_for(ACCURACY))
    return rounded(accuracy_features(pairs).select("s1_id", "cand_id", *ACCURACY_CHECKED))


@query("SELECT gram, df, round(idf, 6) AS idf FROM name_idf")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.fit(records(spark, sf_dir), "base"))


@query("SELECT id, gram, round(weight, 6) AS weight FROM name_vec")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rounded(V.transform(rows, "entity_id", "base", V.fit(rows, "base")))


_DOT = "SELECT cand.s1_id, cand.cand_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(sum(a.weight * b.weight), 0.0))) AS v FROM cand LEFT JOIN {k}_vec a ON a.id = cand.s1_id LEFT JOIN {k}_vec b ON b.id = cand.cand_id AND b.gram = a.gram GROUP BY 1, 2"


@query(f"SELECT n.s1_id, n.cand_id, round(n.v, 6) AS name_tfidf_cosine, round(d.v, 6) AS addr_tfidf_cosine FROM ({_DOT.format(k='name')}) n JOIN ({_DOT.format(k='addr')}) d ON d.s1_id = n.s1_id AND d.cand_id = n.cand_id")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(spark, sf_dir)
    rows, pairs = run.records, run.found
    out = pairs.select("s1_id", "cand_id")
    for kind, column in (("name", "base"), ("addr", "addr")):
        vectors = V.transform(rows, "entity_id", column, V.fit(rows, column))
        out = out.join(V.cosines(pairs, vectors, vectors, f"{kind}_tfidf_cosine"), ["s1_id", "cand_id"])
    return rounded(out)


@query("""SELECT a.vec_id, b.vec_id AS other_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    other = v.select((c("vec_id") - 1).alias("vec_id"), c("vec_id").alias("other_id"), c("embedding").alias("o"))
    return rounded(v.join(other, "vec_id").select("vec_id", "other_id", S.cosine(c("embedding"), c("o")).alias("cosine")))


@query("SELECT s1_id, cand_id, round(ml, 6) AS value FROM blends")
def blend_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, "baseline_prob").withColumnRenamed("score", "ml_prob")
    return rounded(s.select("s1_id", "cand_id", D.blend_ml(s).alias("value")))


@query("SELECT s1_id, cand_id, round(ensemble, 6) AS value FROM blends")
def blend_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, *D.BLENDED).withColumnRenamed("score", "ml_prob")
    return rounded(s.select("s1_id", "cand_id", D.blend_ensemble(s).alias("value")))


@query("SELECT s1_id, cand_id, round(guarded, 6) AS value FROM guards")
def guard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir, "baseline_prob", *D.GUARDED).withColumnRenamed("score", "ml_prob")
    return rounded(s.select("s1_id", "cand_id", D.guarded(s, D.blend_ml(s)).alias("value")))


def base_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Run(spark, sf_dir).matches


@query("SELECT s1_id, cand_id, round(score, 6) AS score FROM matches")
def decide_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base_matches(spark, sf_dir))


@query("SELECT s1_id, cand_id, round(score, 6) AS score FROM matches2")
def decide_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.decide_reranked(scored(spark, sf_dir), 0.55, 0.12, 0.65))


@query(f"SELECT s1_id, n_true, n_pred, tp, round({O.score_of()}, 6) AS f05 FROM counts")
def entity_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.entity_scores(R.truth(spark, sf_dir), base_matches(spark, sf_dir)))


@query(f"SELECT round(avg({O.score_of()}), 6) AS macro_f0_5, count(*) AS n_entities, count(*) FILTER (WHERE n_true = 0) AS n_singletons, count(*) FILTER (WHERE n_true > 0) AS n_with_matches FROM counts")
def macro_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.macro_f05(R.truth(spark, sf_dir), base_matches(spark, sf_dir)))


@query(f"SELECT {O.figures()} FROM counts")
def full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.full_metrics(R.truth(spark, sf_dir), base_matches(spark, sf_dir)))


@query(f"SELECT threshold, margin, {O.figures()} FROM counts2 GROUP BY threshold, margin")
def grid_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.grid_2d(scored(spark, sf_dir), R.truth(spark, sf_dir)))


@query(f"SELECT threshold, hurdle, margin, {O.figures()} FROM counts3 GROUP BY threshold, hurdle, margin")
def grid_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.grid_3d(scored(spark, sf_dir), R.truth(spark, sf_dir)))


@query(f"SELECT threshold, margin, {O.figures()} FROM counts2 GROUP BY threshold, margin ORDER BY round(avg({O.score_of()}), 12) DESC, threshold, margin LIMIT 1")
def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.best_2d(M.grid_2d(scored(spark, sf_dir), R.truth(spark, sf_dir))))


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the trained baseline model: s1_id, cand_id, score, fold."""
    from .runs import train_baseline

    return train_baseline(*sides(spark, sf_dir), R.truth(spark, sf_dir)).scored


@query()
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blended and guarded scores of both trained models."""
    from .runs import train_baseline, train_reranker

    a, b = sides(spark, sf_dir)
    truth = R.truth(spark, sf_dir)
    return train_reranker(train_baseline(a, b, truth), a, b, truth).scored


_LISTS = "SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(m.cand_id, ',' ORDER BY m.cand_id), '') AS {n} FROM s1 e LEFT JOIN {t} m ON m.s1_id = e.entity_id GROUP BY 1"


@query(_LISTS.format(n="matched_entity_ids", t="matches"))
def matching_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = Run(spark, sf_dir)
    return tsv.matching_results(run.sides[0].select(c("entity_id").alias("s1_id")), run.matches)


@query(_LISTS.format(n="candidate_entity_ids", t="cand"))
def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sides(spark, sf_dir)
    return tsv.candidate_pairs(a.select(c("entity_id").alias("s1_id")), B.candidates(a, b))


@query("SELECT s1_id, unnest(truth) AS cand_id FROM truth")
def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.true_pairs(R.truth(spark, sf_dir))


#: Result rows with every kind of mistake, over the derived ids.
_BROKEN = """SELECT line, n_fields, s1_id, ids FROM (
    SELECT CAST(split_part(entity_id, '-', 2) AS BIGINT) + 2 AS line, CASE WHEN CAST(split_part(entity_id, '-', 2) AS BIGINT) % 7 = 6 THEN 3 ELSE 2 END AS n_fields,
    CASE CAST(split_part(entity_id, '-', 2) AS BIGINT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'S1-x' ELSE entity_id END AS s1_id,
    CASE CAST(split_part(entity_id, '-', 2) AS BIGINT) % 4 WHEN 0 THEN 'S2-1,S2-1' WHEN 1 THEN 'X-1' WHEN 2 THEN 'S2-none' ELSE '' END AS ids {from_})"""
_RULES = """WITH rows_ AS ({rows}), fine AS (SELECT * FROM rows_ WHERE n_fields <= 2), named AS (SELECT * FROM fine WHERE s1_id <> ''),
    each_ AS (SELECT line, trim(x) AS id, pos FROM (SELECT line, unnest(string_split(ids, ',')) AS x, generate_subscripts(string_split(ids, ','), 1) AS pos FROM named WHERE ids <> '') WHERE trim(x) <> '')
    SELECT 'columns' AS rule, line::VARCHAR AS at, n_fields::VARCHAR AS detail FROM rows_ WHERE n_fields > 2
    UNION ALL SELECT 'empty_id', line::VARCHAR, '' FROM fine WHERE s1_id = ''
    UNION ALL SELECT 'duplicate_id', line::VARCHAR, s1_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY line) AS k FROM named) WHERE k > 1
    UNION ALL SELECT 'unknown_id', line::VARCHAR, s1_id FROM named WHERE s1_id NOT IN (SELECT entity_id FROM a1)
    UNION ALL SELECT 'duplicate_in_list', line::VARCHAR, id FROM (SELECT *, row_number() OVER (PARTITION BY line, id ORDER BY pos) AS k FROM each_) WHERE k > 1
    UNION ALL SELECT 'prefix', line::VARCHAR, id FROM each_ WHERE id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%'
    UNION ALL SELECT 'unknown_match', line::VARCHAR, id FROM each_ WHERE id NOT IN (SELECT entity_id FROM a2)
    UNION ALL SELECT 'missing_entity', entity_id, '' FROM a1 WHERE entity_id NOT IN (SELECT s1_id FROM named)"""
_A1 = O.sql("SELECT entity_id FROM rec WHERE src = 1")
_A2 = O.sql("SELECT entity_id FROM rec WHERE src > 1")


def validate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = R.source(spark, sf_dir, 1), R.source(spark, sf_dir, 2, 3)
    number = F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("long")
    rows = a.select(
        (number + 2).alias("line"), F.when(number % 7 == 6, 3).otherwise(2).alias("n_fields"),
        F.when(number % 5 == 0, "").when(number % 5 == 1, "S1-x").otherwise(c("entity_id")).alias("s1_id"),
        F.when(number % 4 == 0, "S2-1,S2-1").when(number % 4 == 1, "X-1").when(number % 4 == 2, "S2-none").otherwise("").alias("ids"),
    )
    return Q.row_violations(rows, a.select("entity_id"), b.select("entity_id"))


QUERIES["validate_format"] = validate_format
ORACLES["validate_format"] = "WITH a1 AS (" + _A1 + "), a2 AS (" + _A2 + "), " + _RULES.format(rows=_BROKEN.format(from_="FROM a1"))[len("WITH ") :]


@query("SELECT s1_id, cand_id FROM cand WHERE NOT EXISTS (SELECT 1 FROM matches WHERE matches.s1_id = cand.s1_id AND matches.cand_id = cand.cand_id)")
def validate_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates taken as matches and matches as candidates: everything that wasn't matched is a violation."""
    run = Run(spark, sf_dir)
    return Q.subset_violations(run.found, run.matches)
