"""Tab-separated sources and sinks: strings only, empty instead of null."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
MATCHES = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


#: A field within one line: quoted and closed, or without a quote at its start.
FIELD = r'(?:"(?:[^"\r]++|"")*+"|[^"\t\r][^\t\r]*+)?+'


def breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether some field isn't closed within its line, so that lines can't be read one by one."""
    whole = rf"\A{FIELD}(?:\t{FIELD})*+\r?\z"
    return not spark.read.text(path, lineSep="\n").filter(~F.col("value").rlike(whole)).isEmpty()


def _read(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """Files are split among tasks, unless a quoted field holds a line break: then each file is one task. A scan of the text tells."""
    # Types are never inferred; a header is a line of text, so reading it scans nothing else.
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=breaks_lines(spark, path))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RECORD)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRUTH)


def as_id_list(text):
    """A comma list as distinct ids in order; empty text as no id."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, ",")))


def truth_lists(truth: DataFrame) -> DataFrame:
    """s1_id and truth (array) of every entity, those without a match included."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), as_id_list(F.col("matched_entity_ids")).alias("truth"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth_lists(truth).select("s1_id", F.explode("truth").alias("cand_id"))


def id_lists(entities: DataFrame, pairs: DataFrame, id_col: str, list_col: str, order: str = "cand_id") -> DataFrame:
    """One row per entity with its ids, distinct, by `order`, joined by commas; empty where there is none."""
    lists = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "cand_id"))).alias("l"))
    text = F.array_join(F.array_distinct(F.transform("l", lambda s: s["cand_id"])), ",")
    return entities.select("s1_id").distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias(id_col), F.coalesce(text, F.lit("")).alias(list_col))


def matching_results(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    return id_lists(entities, pairs, *MATCHES)


def candidate_pairs(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    return id_lists(entities, pairs, *CANDIDATES)


def write_id_lists(lists: DataFrame, path: str) -> None:
    """A folder of part files, each a header and unquoted rows; as many as partitions."""
    lists.write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=True, quote="", lineSep="\n")


def write_id_file(lists: DataFrame, path: str) -> None:
    """One file with one header, for users that take no folder. Only the writing, which streams, is one task."""
    jvm = lists.sparkSession.sparkContext._jvm
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    write_id_lists(lists.repartition(1), folder)
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(lists.sparkSession.sparkContext._jsc.hadoopConfiguration())
    (part,) = (s.getPath() for s in fs.globStatus(Path(f"{folder}/part-*")))
    fs.delete(Path(path), True)
    if not fs.rename(part, Path(path)):
        raise OSError(f"{path} can't be written")
    fs.delete(Path(folder), True)


def write_thresholds(spark: SparkSession, path: str, threshold: float, margin: float, hurdle: float | None = None) -> None:
    values = {"threshold": threshold, "margin": margin} | ({} if hurdle is None else {"hurdle": hurdle})
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_thresholds(spark: SparkSession, path: str) -> dict[str, float]:
    """threshold, margin, and the hurdle, which is the threshold where none was written."""
    found = json.loads(spark.read.text(path).first()[0])
    return {"hurdle": found["threshold"]} | found


def raw_ids(source: DataFrame) -> DataFrame:
    return source.select(F.trim("entity_id").alias("entity_id")).filter("entity_id != ''").distinct()
