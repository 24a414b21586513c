"""Quality rules: base counts and the divergence of a text from its language.

A text's histogram of character classes and its histogram of the language's commonest
words are compared with the language's references by Jensen-Shannon divergence's root,
the Jensen-Shannon distance (base 2, 0 to 1). The references come from the whole corpus:
the commonest words by document frequency, then the mean histogram over distinct texts
that pass the base rules, so that a large group of copies counts once. A guard lets
texts that are too short for a histogram pass that test. A text with none of the
common words lies at a distance that their share of the reference fixes, so where
that share is large enough to tell, texts that lack common words are held to a part of that distance.

Null texts have no words and fail the base rules. Null languages form one language of
their own; languages behind the `languages` most frequent ones share a pooled reference.
Ties in frequency are ordered by name. Repeated rows each return a row. Other columns
aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh, small_batches, written

SYMBOLS = "#*$%&|<>"
#: The character classes of a text's histogram.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "point": b".,;:!?'\"()-", "space": b" \t\n\x0b\x0c\r"}
STRIP = b".,;:!?'\"()-" + SYMBOLS.encode()
POOLED = "*"
SCALE = 1_000_000


def _class_table() -> np.ndarray:
    """Class of each byte: those of CLASSES, then other ASCII, then lead bytes of other code points, then bytes that aren't counted."""
    n = len(CLASSES)
    table = np.full(256, n, np.uint8)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    table[0x80:0xC0] = n + 2
    table[0xC0:] = n + 1
    return table


CLASS_OF = _class_table()
N_CLASSES = len(CLASSES) + 2


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first one included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_metrics(text: str) -> tuple[list[bytes], bytes, dict[str, int]]:
    raw = text.encode()
    words = raw.split()
    lines, again = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            again += line in lines
            lines.add(line)
    n, repeated = len(words), repeat_words(words)
    return words, raw, {
        "n_words": n,
        "word_chars": len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": again,
        "n_repeat_words": repeated,
        "base_failed": n < 50 or 100 * repeated > 50 * n,
    }


def normal(word: bytes) -> bytes:
    return word.strip(STRIP).lower()


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of counts or shares; 0 where either row is empty."""
    p, q = (x / np.maximum(x.sum(-1, keepdims=True), 1e-300) for x in (np.asarray(p, float), np.asarray(q, float)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(-1)
        d = np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))
    return np.where((p.sum(-1) > 0) & (q.sum(-1) > 0), d, 0.0)


def frequent_languages(docs: DataFrame, languages: int) -> list[str]:
    rows = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    return [r["lang"] for r in rows]


def common_words(docs: DataFrame, k: int, flush: int = 300_000) -> dict[str, list[bytes]]:
    """The k words of the highest document frequency in each language: at most languages x k of them."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            return {"lang": [x[0] for x in keys], "word": [x[1] for x in keys], "df": [counts[x] for x in keys]}

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.update((lang, w) for w in {normal(w) for w in set((text or "").encode().split())} if w)
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        yield out()

    each = arrow_map(docs.select("lang", "text"), run, "lang string, word binary, df long")
    total = each.groupBy("lang", "word").agg(F.sum("df").alias("df"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "word"))
    found: dict[str, list[bytes]] = {}
    for r in total.withColumn("rank", rank).filter(F.col("rank") <= k).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(bytes(r["word"]))
    return found


def measured(docs: DataFrame, words: dict[str, list[bytes]], k: int) -> DataFrame:
    """Base figures and both histograms of every row."""
    places = {lang: {w: i for i, w in enumerate(ws)} for lang, ws in words.items()}

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "words")}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws, raw, figures = base_metrics(text or "")
                for name, v in figures.items():
                    out[name].append(v)
                out["classes"].append(np.bincount(CLASS_OF[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES])
                place, hist = places.get(lang, {}), [0] * (k + 1)
                for w, c in Counter(ws).items():
                    hist[place.get(normal(w), k)] += c
                out["words"].append(hist)
            yield {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "lang": batch.column("lang"), **out}

    return arrow_map(docs, run, "doc_id long, row_key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, classes array<int>, words array<int>")


def references(table: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms by language over distinct texts that pass the base rules, in whole millionths so that sums don't depend on their order."""
    distinct = table.filter(~F.col("base_failed")).groupBy("lang", "row_key").agg(F.first("classes").alias("classes"), F.first("words").alias("words"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            rows = np.hstack([_shares(batch.column(c)) for c in ("classes", "words")])
            for lang in np.unique(langs):
                sums[str(lang)] = sums.get(str(lang), 0) + rows[langs == lang].sum(0)
        if sums:
            n = len(next(iter(sums.values())))
            yield {"lang": [x for x in sums for _ in range(n)], "at": list(range(n)) * len(sums), "part": np.concatenate(list(sums.values()))}

    # Summed by language and place before they come to the driver: at most `languages` rows of each place.
    each = arrow_map(distinct.select("lang", "classes", "words"), run, "lang string, at int, part long").groupBy("lang", "at").agg(F.sum("part").alias("part"))
    got: dict[str, dict[int, int]] = {}
    for r in each.collect():
        got.setdefault(r["lang"], {})[r["at"]] = r["part"]
    whole = {lang: np.array([parts[i] for i in range(len(parts))], np.int64) for lang, parts in got.items()}
    return {lang: (s[:N_CLASSES], s[N_CLASSES:]) for lang, s in whole.items()}


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _shares(column: pa.Array) -> np.ndarray:
    m = _matrix(column).astype(np.int64)
    return m * SCALE // np.maximum(m.sum(1, keepdims=True), 1)


def word_limits(refs: dict[str, tuple[np.ndarray, np.ndarray]], most: float, bare_limit: float, least_share: float) -> dict[str, float]:
    """Limit of the word distance by language: at most bare_limit times the distance of a text without common words, if these make up least_share of the reference."""
    out = {}
    for lang, (_, ref) in refs.items():
        bare = np.zeros(len(ref))
        bare[-1] = 1
        tells = ref[:-1].sum() >= least_share * ref.sum()
        out[lang] = min(most, bare_limit * float(js_distance(bare[None], ref[None].astype(float))[0])) if tells else most
    return out


def quality(docs: DataFrame, class_limit: float = 0.30, word_limit: float = 0.60, bare_limit: float = 0.9, least_share: float = 0.2, min_words: int = 80, k: int = 64, languages: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base figures, both distances and `kept` of every row of docs, with row_key (xxhash64 of the text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    frequent = frequent_languages(docs, languages)
    docs = docs.withColumn("lang", F.when(F.col("lang").isin(frequent), F.col("lang")).otherwise(F.lit(POOLED)))
    table = written(measured(docs, common_words(docs, k), k), "quality")
    refs = references(table)
    limits = word_limits(refs, word_limit, bare_limit, least_share)

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            far = {}
            for column, part in (("classes", 0), ("words", 1)):
                rows = _matrix(batch.column(column)).astype(float)
                ref = np.array([refs[x][part] if x in refs else np.zeros(rows.shape[1]) for x in langs], float).reshape(rows.shape)
                far[column] = js_distance(rows, ref)
            n = batch.column("n_words").to_numpy()
            # The language's own limit is for texts with fewer of the common words than the reference, not for those with more.
            lacks = rows[:, -1] * ref.sum(1) > ref[:, -1] * rows.sum(1)
            limit = np.where(lacks, [limits.get(x, word_limit) for x in langs], word_limit)
            fits = (n < min_words) | ((far["classes"] <= class_limit) & (far["words"] <= limit))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            yield {name: batch.column(name) for name in ("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"kept": fits & ~failed.astype(bool), "class_distance": far["classes"], "word_distance": far["words"]}

    return arrow_map(table, run, "doc_id long, row_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")


def quality_filter(docs: DataFrame, few: int = 100_000, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs that `quality` keeps, with the columns of docs. Up to `few` rejected rows' keys are sent to every executor; beyond that, texts are shuffled to them."""
    key, its = fresh(docs, "row_hash", "gone_hash")
    as_key = lambda i, t: F.xxhash64(F.coalesce(i.cast("string"), F.lit("none")), t)
    gone = quality(docs, id_col=id_col, text_col=text_col, **parameters).filter(~F.col("kept")).select(as_key(F.col("doc_id"), F.col("row_key")).alias(its))
    gone = written(gone.distinct(), "rejected")
    keyed = docs.withColumn(key, as_key(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    return keyed.join(F.broadcast(gone) if gone.count() <= few else gone, F.col(key) == F.col(its), "left_anti").drop(key)
