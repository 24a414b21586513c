"""Per-entity F0.5, its macro mean and further figures, and threshold grids as one aggregation."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The grids that thresholds are chosen from.
GRID_2D = [(round(0.30 + 0.02 * i, 2), round(0.05 + 0.02 * j, 2)) for i, j in product(range(29), range(8))]
GRID_3D = list(product([round(0.35 + 0.05 * i, 2) for i in range(13)], [round(0.45 + 0.05 * i, 2) for i in range(7)], [0.10, 0.12, 0.15]))


def f_beta(tp: Column, predicted: Column, true: Column, beta2: float = 0.25) -> Column:
    """F-beta of one entity from its counts; nothing predicted where nothing is true is 1, one of both empty is 0."""
    score = (1 + beta2) * tp / F.greatest(beta2 * true + predicted, F.lit(1e-12))
    return F.when((true == 0) & (predicted == 0), 1.0).when((true == 0) | (predicted == 0), 0.0).otherwise(score)


def true_pairs(truth: DataFrame) -> DataFrame:
    """s1_id and cand_id of a truth: either a row per pair (cand_id null where an entity has none) or a row per entity with the array `truth`."""
    if "truth" in truth.columns:
        return truth.select("s1_id", F.explode("truth").alias("cand_id")).distinct()
    return truth.filter("cand_id IS NOT NULL").select("s1_id", "cand_id").distinct()


def true_sizes(truth: DataFrame) -> DataFrame:
    """s1_id and n_true of every entity of a truth."""
    if "truth" in truth.columns:
        return truth.select("s1_id", F.size(F.array_distinct("truth")).cast("long").alias("n_true"))
    return truth.select("s1_id", "cand_id").distinct().groupBy("s1_id").agg(F.count("cand_id").alias("n_true"))


def entity_counts(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, tp of every entity of the truth."""
    true = true_pairs(truth).withColumn("t", F.lit(1))
    hits = matches.select("s1_id", "cand_id").distinct().join(true, ["s1_id", "cand_id"], "left")
    predicted = hits.groupBy("s1_id").agg(F.count("*").alias("n_pred"), F.count("t").alias("tp"))
    return true_sizes(truth).join(predicted, "s1_id", "left").na.fill(0, ["n_pred", "tp"])


def entity_scores(truth: DataFrame, matches: DataFrame) -> DataFrame:
    counts = entity_counts(truth, matches)
    return counts.withColumn("f05", f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def _figures() -> list[Column]:
    tp, pred, true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    out = {
        "macro_f0_5": F.avg(f_beta(tp, pred, true)),
        "macro_precision": F.coalesce(F.avg(F.when(pred > 0, tp / F.greatest(pred, F.lit(1)))), F.lit(1.0)),
        "macro_recall": F.coalesce(F.avg(F.when(true > 0, tp / F.greatest(true, F.lit(1)))), F.lit(0.0)),
        "n_entities": F.count("*"), "n_predicted_matches": F.sum(pred), "n_tp": F.sum(tp), "n_fp": F.sum(pred - tp), "n_fn": F.sum(true - tp),
        "n_singletons": F.count_if(true == 0), "n_with_matches": F.count_if(true > 0),
        "n_correct_singletons": F.count_if((true == 0) & (pred == 0)), "n_false_merge_singletons": F.count_if((true == 0) & (pred > 0)),
    }
    return [c.alias(n) for n, c in out.items()]


def full_metrics(truth: DataFrame, matches: DataFrame) -> DataFrame:
    return entity_counts(truth, matches).agg(*_figures())


def macro_f05(truth: DataFrame, matches: DataFrame) -> DataFrame:
    return full_metrics(truth, matches).select("macro_f0_5", "n_entities", "n_singletons", "n_with_matches")


def _grid(scored: DataFrame, truth: DataFrame, grid: DataFrame, least: float, keep: Callable[[Column], Column]) -> DataFrame:
    """Figures of every grid row; keep takes no score below least, the grid's least threshold, so those only count for an entity's best, and no truth is looked up for them. Scores cross the grid (at most some hundred rows, a fixed list), counts are summed per entity, entities without a match are added by the grid alone."""
    keys = grid.columns
    true = true_pairs(truth).withColumn("t", F.lit(1))
    known = true_sizes(truth)
    rows = scored.select("s1_id", "cand_id", "score", F.max("score").over(Window.partitionBy("s1_id")).alias("top")).filter(F.col("score") >= least)
    rows = rows.join(true, ["s1_id", "cand_id"], "left").groupBy("s1_id", "top").agg(F.collect_list(F.struct("score", F.coalesce("t", F.lit(0)).alias("t"))).alias("c"))
    rows = known.join(rows, "s1_id", "left").crossJoin(F.broadcast(grid))
    picked = F.coalesce(F.filter("c", lambda s: keep(s["score"])), F.array().cast("array<struct<score:double,t:int>>"))
    counts = rows.withColumn("p", picked).select(*keys, "n_true", F.size("p").cast("long").alias("n_pred"), F.aggregate("p", F.lit(0).cast("long"), lambda a, s: a + s["t"]).alias("tp"))
    return counts.groupBy(*keys).agg(*_figures())


def grid_2d(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """threshold, margin and figures by the baseline decision, the hurdle being the threshold."""
    grid = scored.sparkSession.createDataFrame(GRID_2D, "threshold double, margin double")
    keep = lambda s: (F.col("top") >= F.col("threshold")) & (s >= F.col("threshold")) & (F.col("top") - s <= F.col("margin"))
    return _grid(scored, truth, grid, min(t for t, _ in GRID_2D), keep)


def grid_3d(scored: DataFrame, truth: DataFrame, sure: float = 0.70) -> DataFrame:
    """threshold, hurdle, margin and figures by the reranked decision."""
    grid = scored.sparkSession.createDataFrame(GRID_3D, "threshold double, hurdle double, margin double")
    keep = lambda s: (F.col("top") >= F.col("hurdle")) & (s >= F.col("threshold")) & ((s >= F.col("top") - F.col("margin")) | (s >= sure))
    return _grid(scored, truth, grid, min(t for t, _, _ in GRID_3D), keep)


def best_2d(figures: DataFrame) -> DataFrame:
    """The first strict maximum: the highest F0.5, then the least threshold, then the least margin."""
    return figures.orderBy(F.round("macro_f0_5", 12).desc(), "threshold", "margin").limit(1)


def best_3d(figures: DataFrame) -> dict:
    """The winner of a fold in loop order: a row replaces the best if its F0.5 is higher, or within 1e-4 with higher precision. That isn't a total order, so the rows (a fixed number) are folded here."""
    best: dict | None = None
    for row in (r.asDict() for r in figures.orderBy("threshold", "hurdle", "margin").collect()):
        if best is None or row["macro_f0_5"] > best["macro_f0_5"] or (abs(row["macro_f0_5"] - best["macro_f0_5"]) < 1e-4 and row["macro_precision"] > best["macro_precision"]):
            best = row
    return best or {}
