"""Organisation records derived from the driver's tables, which hold none.

Every document is a record; its first line, in lower case, is the organisation. Source 1
is deduplicated, as references are: of a line's documents whose id divides by 3 the least
one is its reference record, and the others go to sources 2 and 3. So a line that a third
of all documents begin with has one reference record, and true pairs are no more than records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tsv import RECORD


def documents(spark: SparkSession, sf_dir: str, *made: Column) -> tuple[DataFrame, DataFrame]:
    """doc_id, k (the first line in lower case, as its SHA-256) and what made makes of l1 (the first line) and lang; and k with first, the reference's doc_id.

    A first line may be a whole text, so lines aren't moved between tasks: only k and what made makes are.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("l1"))
    docs = docs.select("doc_id", F.unhex(F.sha2(F.lower("l1"), 256)).alias("k"), *made)
    # Only documents that may be references meet the least ids; sums come before shuffles, so a frequent line is one row.
    return docs, docs.filter(F.col("doc_id") % 3 == 0).groupBy("k").agg(F.min("doc_id").alias("first"))


def entity_id() -> Column:
    return F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("doc_id").cast("string"))


def with_source(docs: DataFrame) -> DataFrame:
    """docs with src (1, 2, 3), by doc_id and first."""
    third = F.col("doc_id") % 3
    return docs.withColumn("src", F.when(third > 0, third + 1).when(F.col("doc_id") == F.col("first"), 1).otherwise(F.floor(F.col("doc_id") / 3) % 2 + 2).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src (1, 2, 3), k (of the lower-cased first line) and the four columns of a record."""
    word = lambda start: F.array_join(F.slice(F.split("l1", " "), start, 5), " ")
    length = F.length("l1")
    address = F.concat(length.cast("string"), F.lit(" "), word(6), F.lit(" Street "), (10000 + length * 37 % 89999).cast("string"))
    docs, least = documents(spark, sf_dir, word(1).alias("business_name"), address.alias("business_address"), F.col("lang").alias("country"))
    return with_source(docs.join(least, "k", "left")).select("src", "k", entity_id().alias("entity_id"), "business_name", "business_address", "country")


def source(spark: SparkSession, sf_dir: str, *which: int) -> DataFrame:
    return records(spark, sf_dir).filter(F.col("src").isin(*which)).select(*RECORD)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id and cand_id of each S2 and S3 record with the same first line, and each s1_id with a null cand_id."""
    docs, least = documents(spark, sf_dir)
    # A reference is the first of its line, so its own row is the one of the null.
    return with_source(docs.join(least, "k")).select(F.concat(F.lit("S1-"), F.col("first").cast("string")).alias("s1_id"), F.when(F.col("src") > 1, entity_id()).alias("cand_id"))
