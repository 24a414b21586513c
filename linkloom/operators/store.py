"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel


def stored(df: DataFrame) -> DataFrame:
    """df computed once: a Parquet table where the cluster names a shared folder for checkpoints, of which each branch reads only its columns; else memory and disk, to be recomputed from its lineage if lost."""
    spark = df.sparkSession
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        path = f"{folder.rstrip('/')}/linkloom/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(pairs: DataFrame) -> DataFrame:
    """Candidate pairs dealt evenly over as many partitions as shuffles have: few bytes, but much work for each row, which adaptive coalescing by bytes doesn't see."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "s1_id", "cand_id")
