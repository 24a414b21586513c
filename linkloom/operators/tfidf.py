"""TF-IDF over character grams within words, as a relation of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import pieces


def word_grams(text: Column) -> Column:
    """3- and 4-grams of each word with a space on both sides; a padded word that isn't longer than n is one gram and has no longer ones. Blank text counts as the word "empty"."""
    filled = F.when(text == "", F.lit("empty")).otherwise(text)

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.when(F.length(padded) <= 3, F.array(padded)).otherwise(F.concat(pieces(padded, 3), pieces(padded, 4)))

    return F.flatten(F.transform(F.split(filled, " "), grams))


def fit(corpus: DataFrame, text_col: str, least_df: int = 2) -> DataFrame:
    """gram, df, idf of the grams that at least least_df rows hold."""
    n = corpus.agg(F.count("*").alias("n"))
    df = corpus.select(F.explode(F.array_distinct(word_grams(F.col(text_col)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= least_df)
    return df.crossJoin(F.broadcast(n)).select("gram", "df", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def transform(rows: DataFrame, id_col: str, text_col: str, idf: DataFrame) -> DataFrame:
    """id, gram, weight: (1 + ln tf) idf, each id's weights of length 1; grams that weren't fitted are dropped."""
    tf = rows.select(F.col(id_col).alias("id"), F.explode(word_grams(F.col(text_col))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, "gram").select("id", "gram", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "gram", (F.col("w") / norm).alias("weight"))


def cosines(pairs: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """s1_id, cand_id and the product of their vectors within [0, 1]; 0 where they share no gram."""
    # Vectors as one map per id: a pair then costs one row, not one row per gram.
    as_map = lambda v, key, col: v.groupBy(F.col("id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias(col))
    both = pairs.select("s1_id", "cand_id").join(as_map(left, "s1_id", "va"), "s1_id", "left").join(as_map(right, "cand_id", "vb"), "cand_id", "left")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(F.col("vb"), e["key"]), F.lit(0.0)))
    return both.select("s1_id", "cand_id", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot)), F.lit(0.0)).alias(name))
