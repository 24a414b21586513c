"""Secret scans with corpus-wide ownership frequency.

Three base patterns give spans per text. Every secret value is hashed, and over the
whole corpus its distinct owners and repositories are counted: a value that more than `max_owners`
owners or more than `max_repos` repositories hold is a widely copied example; one that stays
within both and looks random is a live credential. Those add a span of kind `live` over the value.

Null texts count as empty, null owners as one owner of their own, null ids as one
repository. Repeated rows count once in the ownership figures and each return a row.
Ties in start are ordered assign, access, hex, live. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, small_batches, written

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Runs are taken whole, so asking for the least length is the same as dropping short runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words that mark a documentation example.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "1234567890", "password")
CANDIDATE = "array<struct<kind:string,start:int,stop:int,from:int,to:int,hash:string,live:boolean>>"


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start of the value, its end) by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def looks_live(value: str) -> bool:
    """Long, mixed and random enough to be a real credential."""
    if len(value) < 16 or any(p in value.lower() for p in PLACEHOLDERS):
        return False
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.0


def span_text(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per row of docs: base counts and digest, and every span with its value's hash."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in batch.column("text").to_pylist():
                spans = base_spans(text or "")
                kinds = Counter(s[0] for s in spans)
                for k in KINDS[:3]:
                    out["n_" + k].append(kinds[k])
                out["base_sha256"].append(hashlib.sha256(span_text(spans).encode()).hexdigest())
                out["spans"].append([
                    {"kind": k, "start": a, "stop": b, "from": f, "to": t, "hash": hashlib.blake2b(text[f:t].encode(), digest_size=16).hexdigest(), "live": looks_live(text[f:t])}
                    for k, a, b, f, t in spans
                ])
            yield {"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "owner": batch.column("owner"), **out}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.coalesce(F.col(owner_col), F.lit("\0")).alias("owner"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"doc_id long, row_key long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans {CANDIDATE}")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos over the whole corpus. Each step sums before it shuffles, so a value that a third of all rows hold is no hot key."""
    each = found.select("doc_id", "owner", F.explode("spans").alias("s")).select("doc_id", "owner", F.col("s.hash").alias("hash"))
    by_repo = each.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def secret_scan(docs: DataFrame, max_owners: int = 2, max_repos: int = 20, **columns: str) -> DataFrame:
    """Base figures of every row, `spans` as text, and arrays of (from, to): `live`, of values that are owner-specific and look random; `masks`, of all owner-specific values that a name or prefix marks as secret, and of the live ones."""
    found = written(candidates(docs, **columns), "secret-candidates")
    owned = ownership(found).filter((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    each = found.filter(F.size("spans") > 0).select("doc_id", "row_key", F.explode("spans").alias("s"))
    own = each.join(owned, F.col("s.hash") == F.col("hash")).select("doc_id", "row_key", "s")
    place = F.struct(F.col("s.from").alias("from"), F.col("s.to").alias("to"))
    verdict = own.groupBy("doc_id", "row_key").agg(
        F.collect_set(F.when(F.col("s.live"), place)).alias("live"),
        F.collect_set(F.when(F.col("s.live") | (F.col("s.kind") != "hex"), place)).alias("masks"),
    ).select(F.col("doc_id").alias("v_id"), F.col("row_key").alias("v_key"), "live", "masks")
    joined = found.join(verdict, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("row_key") == F.col("v_key")), "left").drop("v_id", "v_key")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    live = F.transform(F.coalesce("live", F.array().cast("array<struct<from:int,to:int>>")), lambda s: F.struct(s["from"].alias("start"), F.lit(3).alias("rank"), F.lit("live").alias("kind"), s["to"].alias("stop")))
    told = F.transform(F.array_sort(F.concat(base, live)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return joined.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(told, ",").alias("spans"), "live", "masks")


def masked(text: str, places: list[tuple[int, int]], mark: str) -> str:
    """text with mark in place of each stretch that places cover; what overlaps is one stretch. One pass over the text."""
    out, at, open_ = [], 0, -1
    for a, b in sorted(places):
        if a >= at or open_ < 0:
            out += [text[at:a], mark]
            open_ = 0
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = 2, max_repos: int = 20, few: int = 100_000, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """docs with every secret value that `masks` of secret_scan covers replaced by mark; all rows stay. Up to `few` texts' masks are sent to every executor; beyond that, texts are shuffled to them."""
    scanned = secret_scan(docs, max_owners, max_repos, id_col=id_col, text_col=text_col, owner_col=owner_col)
    key, its, places = fresh(docs, "mask_key", "mask_of", "mask_places")
    as_key = lambda i, t: F.xxhash64(F.coalesce(i.cast("string"), F.lit("none")), t)
    masks = scanned.filter(F.size("masks") > 0).select(as_key(F.col("doc_id"), F.col("row_key")).alias(its), F.col("masks").alias(places)).dropDuplicates([its])
    masks = written(masks, "secret-masks")
    keyed = docs.withColumn(key, as_key(F.col(id_col).cast("long"), F.xxhash64(text_col)))
    joined = keyed.join(F.broadcast(masks) if masks.count() <= few else masks, F.col(key) == F.col(its), "left").drop(key, its)
    names = docs.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            spots = batch.column(len(names))
            if spots.null_count < len(spots):
                texts, each = columns[text_at].to_pylist(), spots.to_pylist()
                texts = [masked(t, [(p["from"], p["to"]) for p in ps], mark) if ps else t for t, ps in zip(texts, each, strict=True)]
                columns[text_at] = texts
                if chars_at >= 0:
                    columns[chars_at] = [len(t) if ps else n for t, ps, n in zip(texts, each, columns[chars_at].to_pylist(), strict=True)]
            yield dict(zip(names, columns, strict=True))

    small_batches(docs.sparkSession)
    return arrow_map(joined, run, docs.schema)
