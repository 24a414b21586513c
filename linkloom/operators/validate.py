"""Checks of result files, each a relational query; their union is the list of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tsv import CANDIDATES, MATCHES


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1, over all files by name), head (whether it is its file's first) and value of the text files at path."""
    # A file is read in blocks: lines are ranked within a block, and offsets come from the blocks' sizes.
    block = ["file", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    sizes = lines.groupBy(*block).agg(F.count("*").alias("n"))
    offsets = sizes.select(*block, (F.sum("n").over(Window.orderBy(*block)) - F.col("n")).alias("before"), (F.sum("n").over(Window.partitionBy("file").orderBy("start")) - F.col("n")).alias("above"))
    ranked = lines.withColumn("k", F.row_number().over(Window.partitionBy(*block).orderBy("i"))).join(offsets, block)
    return ranked.select((F.col("k") + F.col("before")).alias("line"), (F.col("k") + F.col("above") == 1).alias("head"), "value")


def fields(lines: DataFrame) -> DataFrame:
    """line, n_fields, s1_id, ids of every line but the headers."""
    parts = F.split("value", "\t")
    return lines.filter("NOT head").select("line", F.size(parts).alias("n_fields"), F.trim(parts[0]).alias("s1_id"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("ids"))


def header_violations(lines: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    found = lines.filter(F.col("head") & (F.col("value") != "\t".join(expected)))
    return found.select(F.lit("header").alias("rule"), F.col("line").cast("string").alias("at"), F.col("value").alias("detail"))


def row_violations(rows: DataFrame, s1_ids: DataFrame, other_ids: DataFrame) -> DataFrame:
    """rule, at, detail of every broken rule over rows (line, n_fields, s1_id, ids). A check against ids is skipped where there are none."""

    def rule(df: DataFrame, name: str, at: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(name).alias("rule"), at.cast("string").alias("at"), detail.cast("string").alias("detail"))

    line = F.col("line")
    fine = rows.filter("n_fields <= 2")
    named = fine.filter("s1_id != ''")
    each = named.filter("ids != ''").select("line", "s1_id", F.posexplode(F.split("ids", ",")).alias("pos", "raw")).withColumn("id", F.trim("raw")).filter("id != ''")
    some_s1, some_other = s1_ids.agg((F.count("*") > 0).alias("any")), other_ids.agg((F.count("*") > 0).alias("any"))
    ids1 = s1_ids.select(F.col("entity_id").alias("s1_id")).distinct()
    ids2 = other_ids.select(F.col("entity_id").alias("id")).distinct()
    repeated = F.row_number().over(Window.partitionBy("s1_id").orderBy("line"))
    again = F.row_number().over(Window.partitionBy("line", "id").orderBy("pos"))
    checks = [
        rule(rows.filter("n_fields > 2"), "columns", line, F.col("n_fields")),
        rule(fine.filter("s1_id = ''"), "empty_id", line, F.lit("")),
        rule(named.withColumn("k", repeated).filter("k > 1"), "duplicate_id", line, F.col("s1_id")),
        rule(named.join(ids1, "s1_id", "left_anti").crossJoin(some_s1).filter("any"), "unknown_id", line, F.col("s1_id")),
        rule(each.withColumn("k", again).filter("k > 1"), "duplicate_in_list", line, F.col("id")),
        rule(each.filter(~F.startswith("id", F.lit("S2-")) & ~F.startswith("id", F.lit("S3-"))), "prefix", line, F.col("id")),
        rule(each.join(ids2, "id", "left_anti").crossJoin(some_other).filter("any"), "unknown_match", line, F.col("id")),
        rule(ids1.join(named.select("s1_id").distinct(), "s1_id", "left_anti"), "missing_entity", F.col("s1_id"), F.lit("")),
    ]
    return reduce(DataFrame.unionByName, checks)


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, cand_id) that are no candidates."""
    return matches.select("s1_id", "cand_id").distinct().join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.filter("ids != ''").select("s1_id", F.explode(F.split("ids", ",")).alias("cand_id")).select("s1_id", F.trim("cand_id").alias("cand_id")).filter("cand_id != ''")


def validate_files(spark: SparkSession, matching: str, candidate: str, s1_ids: DataFrame, other_ids: DataFrame) -> DataFrame:
    """All violations of both results (files, or folders of files with a header each) and of matches being candidates; no row means they pass."""
    out = []
    rows = {}
    for name, path, header in (("matching", matching, MATCHES), ("candidate", candidate, CANDIDATES)):
        lines = numbered_lines(spark, path)
        rows[name] = fields(lines)
        out += [v.select(F.lit(name).alias("file"), "*") for v in (header_violations(lines, header), row_violations(rows[name], s1_ids, other_ids))]
    stray = subset_violations(pairs_of(rows["matching"]), pairs_of(rows["candidate"]))
    out.append(stray.select(F.lit("matching").alias("file"), F.lit("not_a_candidate").alias("rule"), F.col("s1_id").alias("at"), F.col("cand_id").alias("detail")))
    return reduce(DataFrame.unionByName, out)


def passes(violations: DataFrame) -> bool:
    return violations.isEmpty()
