"""A corpus from raw documents to token ids, in five stages, each one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.bpe import bpe
from linkloom.llm.common import written
from linkloom.llm.mixing import mixed
from linkloom.llm.quality import quality_filter
from linkloom.llm.queries import documents, tokenizer
from linkloom.llm.secrets import redact
from linkloom.llm.wide_simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language."""
    return quality_filter(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of texts with a similarity of 0.8 or more in five-word shingles."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that aren't widely copied examples masked."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, in blocks of up to 2,048 words (a 256th of its source's target); a document of up to a block's width is taken as a whole, or twice, or not."""
    return mixed(docs, widest=2048, whole=True)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of every row."""
    return bpe(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe", bpe_encode),
]

#: SQL can't express XXH64 fingerprints, keyed permutations or BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
