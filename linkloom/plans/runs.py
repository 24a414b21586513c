"""Training, evaluation and prediction from records to result lists.

A run stores candidate pairs with their records and edit ratios, and the pair features, once each (a checkpoint in
the shared folder where there is one), since the model fit, its tuning and the scores read them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking as B
from ..operators import decide as D
from ..operators import metrics as M
from ..operators import model as L
from ..operators import pairs as C
from ..operators import tfidf as V
from ..operators.features import accuracy_features, base_features, with_ratios
from ..operators.prepare import with_forms
from ..operators.store import spread, stored
from ..sources import tsv

FOLDS = 5


def pair_table(references: DataFrame, others: DataFrame, top_k: int = B.TOP_K) -> DataFrame:
    """Candidate pairs with both records' forms and the edit ratios; records and ratios are stored, forms are made when they are read."""
    found = stored(spread(B.candidates(references, others, top_k=top_k).select("s1_id", "cand_id")))
    return C.each_side(stored(with_ratios(C.join_records(found, references.drop("tokens"), others.drop("tokens")))), with_forms)


@dataclass
class Baseline:
    pairs: DataFrame | None  # with records and ratios; none in a stored run
    model: PipelineModel
    scored: DataFrame | None  # s1_id, cand_id, score, fold
    threshold: float
    margin: float


@dataclass
class Reranked:
    model: PipelineModel
    features: DataFrame | None
    scored: DataFrame | None  # s1_id, cand_id, score, fold
    threshold: float
    hurdle: float
    margin: float


def _fold():
    return C.md5_fold(F.col("s1_id"), FOLDS)


def train_baseline(references: DataFrame, others: DataFrame, truth: DataFrame, ratio: float = 6.0) -> Baseline:
    """Fits on folds 2 and above, stops early on fold 1, tunes on fold 0."""
    pairs = pair_table(references, others)
    features = stored(C.label(base_features(pairs), truth).withColumn("fold", _fold()))
    fitting = C.cap_negatives(features.filter("fold > 1"), ratio).withColumn("stop", F.lit(False)).unionByName(features.filter("fold = 1").withColumn("stop", F.lit(True)))
    model = L.fit_base(fitting, "stop" if features.filter("fold = 1").groupBy("label").count().count() == 2 else None)
    scored = L.predict(model, features).select("s1_id", "cand_id", "score", "fold")
    best = M.best_2d(M.grid_2d(scored.filter("fold = 0").drop("fold"), truth.filter(_fold() == 0))).first()
    return Baseline(pairs, model, scored, best["threshold"], best["margin"])


def rerank_features(base: Baseline, references: DataFrame, others: DataFrame) -> DataFrame:
    """Accuracy features with the baseline's scores and TF-IDF cosines fitted over all records of all sources."""
    rows = references.unionByName(others)
    pairs = base.pairs.join(base.scored.select("s1_id", "cand_id", F.col("score").alias("baseline_prob")), ["s1_id", "cand_id"], "left")
    for kind, column in (("name", "base"), ("addr", "addr")):
        vectors = stored(V.transform(rows, "entity_id", column, V.fit(rows, column)))
        pairs = pairs.join(V.cosines(base.pairs, vectors, vectors, f"{kind}_tfidf_cosine"), ["s1_id", "cand_id"], "left")
    return accuracy_features(pairs)


def rerank(model: PipelineModel, features: DataFrame, mode: str = "ml", alpha: float = 0.50) -> DataFrame:
    """s1_id, cand_id and the blended, guarded score; modes ml and hybrid blend alike."""
    scored = L.predict(model, features, "ml_prob")
    blend = D.blend_ensemble(scored) if mode == "ensemble" else D.blend_ml(scored, alpha)
    return scored.select("s1_id", "cand_id", D.guarded(scored, blend).alias("score"))


def train_reranker(base: Baseline, references: DataFrame, others: DataFrame, truth: DataFrame, kind: str = "trees", mode: str = "ml") -> Reranked:
    features = stored(C.label(rerank_features(base, references, others), truth).withColumn("fold", _fold()))
    model = L.fit_reranker(features.filter("fold > 1"), kind)
    scored = rerank(model, features, mode).withColumn("fold", _fold())
    best = M.best_3d(M.grid_3d(scored.filter("fold = 0").drop("fold"), truth.filter(_fold() == 0)))
    return Reranked(model, features, scored, best["threshold"], best["hurdle"], best["margin"])


def predict_matches(base: Baseline, references: DataFrame, others: DataFrame, reranker: Reranked | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates and matches of new records; matches are a subset of candidates."""
    pairs = pair_table(references, others)
    scored = L.predict(base.model, base_features(pairs)).select("s1_id", "cand_id", "score")
    if reranker is None:
        return pairs.select("s1_id", "cand_id"), D.decide(scored, base.threshold, base.margin)
    new = Baseline(pairs, base.model, scored, base.threshold, base.margin)
    final = rerank(reranker.model, rerank_features(new, references, others))
    return pairs.select("s1_id", "cand_id"), D.decide_reranked(final, reranker.threshold, reranker.margin, reranker.hurdle)


def save(spark: SparkSession, folder: str, base: Baseline, reranker: Reranked | None = None) -> None:
    """Models and thresholds: what predicting needs."""
    L.save(base.model, f"{folder}/baseline/model")
    tsv.write_thresholds(spark, f"{folder}/baseline/thresholds", base.threshold, base.margin)
    if reranker:
        L.save(reranker.model, f"{folder}/reranker/model")
        tsv.write_thresholds(spark, f"{folder}/reranker/thresholds", reranker.threshold, reranker.margin, reranker.hurdle)


def load_baseline(spark: SparkSession, folder: str) -> Baseline:
    t = tsv.read_thresholds(spark, f"{folder}/baseline/thresholds")
    return Baseline(None, L.load(f"{folder}/baseline/model"), None, t["threshold"], t["margin"])


def load_reranker(spark: SparkSession, folder: str) -> Reranked:
    t = tsv.read_thresholds(spark, f"{folder}/reranker/thresholds")
    return Reranked(L.load(f"{folder}/reranker/model"), None, None, t["threshold"], t["hurdle"], t["margin"])


def report(base: Baseline, reranker: Reranked, truth: DataFrame) -> DataFrame:
    """Metric rows of fold 0 before and after reranking, in modes ml and ensemble, with the gain over the baseline."""
    mine = truth.filter(_fold() == 0)
    rows = {"baseline": D.decide(base.scored.filter("fold = 0"), base.threshold, base.margin)}
    for mode in ("ml", "ensemble"):
        scored = rerank(reranker.model, reranker.features.filter("fold = 0"), mode)
        rows[mode] = D.decide_reranked(scored, reranker.threshold, reranker.margin, reranker.hurdle)
    out = None
    for name, matches in rows.items():
        row = M.full_metrics(mine, matches).withColumn("stage", F.lit(name))
        out = row if out is None else out.unionByName(row)
    first = M.full_metrics(mine, rows["baseline"]).select(F.col("macro_f0_5").alias("was"))
    return out.crossJoin(first).withColumn("gain", F.col("macro_f0_5") - F.col("was")).withColumn("relative_gain", F.when(F.col("was") > 0, F.col("gain") / F.when(F.col("was") > 0, F.col("was")))).drop("was")
