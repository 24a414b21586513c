import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def rows():
    """Nulls in every column, empty and blank texts, a long text, repeated rows, exact and near copies, and a shared passage."""
    rng = random.Random(5)
    shared = words(rng, 80)
    base = words(rng, 400)
    out = [(i, words(rng, rng.randint(0, 150)) + "\n" + words(rng, 60), rng.choice(["en", "de", None]), rng.choice(["b", "a", "ä", None]), 1) for i in range(40)]
    out += [(100 + i, base, "en", "a", None) for i in range(5)]
    out += [(110, base + " tail", "en", "b", 1), (111, shared + " " + words(rng, 30), "en", "b", 1), (112, words(rng, 50) + "\n" + shared, "de", "b", 1)]
    out += [(120, None, None, None, None), (121, "", "en", "a", 0), (122, " \t\n ", "en", "a", 4), (123, "one", "en", "c", 3), (None, base, "en", "a", 1), (None, None, None, None, None), (124, words(rng, 30_000), "en", "a", 1)]
    out += [(130, "same row " * 30, "en", "a", 1)] * 2
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    return df.withColumns({n: F.lit("x") for n in ("row_key", "code", "size", "spans", "bundle", "n_words", "kept", "label", "owner", "shard")})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def tokenizer_path():
    P = pytest.importorskip("public_tokenizers")
    return P.path
