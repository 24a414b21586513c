"""Embedding near-duplicates by product quantisation with exact cosine rerank.

Vectors are compared within one label only. Equal vectors form one class. A coarse
quantiser, with a number of lists that grows with the number of classes, deals class vectors to inverted
lists; each list entry carries subspace codes of its residual and the length of what the
codes leave out. Of two neighbours in different lists one at least lies within half their
distance of the border between the two lists, so each vector probes the lists whose border
with its own is within half a neighbour's step: the step's length along the border's
normal, taken as `spread` standard deviations of a step that is spread evenly over all dimensions or like the
vectors themselves, whichever is longer, and never more than the whole step, at which nothing can be lost.
A pair that both sides find is counted on its lesser side. Table look-ups give asymmetric
estimates; since an estimate is off by the left-out length at most, no pair of a
probed list is lost, and candidates are reranked by the exact cosine in double precision.

Only fitting uses a sample (about `sample` vectors, chosen by hash); every vector is indexed and
every vector is a query. Lists are cut into chunks of entries and of queries, so a list
that a third of all vectors fall into is many groups of bounded size, and a group gives
back counts per vector and a forest of links, never all pairs.

Null, empty and zero vectors, vectors with null or non-finite components, and vectors
without a label link with nothing. Vectors of different length aren't compared. Null ids
get no kept flag of their own: component_id is the least id reachable, null if there is
none. Rows that share an id are vectors of their own, each with its own links, and repeated rows link with
each other like any two equal vectors. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, written
from .components import components, local_forest


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray  # lists x dimensions
    books: np.ndarray  # subspaces x codes x dimensions of a subspace
    leaning: np.ndarray  # coarse, put so that squared distances are variances of the vectors along a difference

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = 0) -> Quantiser:
        coarse = kmeans(x, min(lists, len(x)), 8, seed)
        rest = x - coarse[nearest(x, coarse)]
        parts = next(m for m in range(min(subspaces, x.shape[1]), 0, -1) if x.shape[1] % m == 0)
        split = rest.reshape(len(x), parts, -1)
        values, axes = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))
        values = np.maximum(values, 0)
        root = axes * np.sqrt(values / max(values.sum(), 1e-300))
        return cls(coarse, np.stack([kmeans(np.ascontiguousarray(split[:, m]), min(codes, len(x)), 8, seed + m) for m in range(parts)]), coarse @ root)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and left-out length of each vector."""
        place = nearest(x, self.coarse)
        rest = (x - self.coarse[place]).reshape(len(x), len(self.books), -1)
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, m]), b) for m, b in enumerate(self.books)], 1)
        known = np.stack([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return place, codes.astype(np.uint8), np.sqrt(((rest - known) ** 2).sum((1, 2)))

    def probes(self, x: np.ndarray, own: np.ndarray, step: float, spread: float) -> list[np.ndarray]:
        """For each vector of list `own` the lists whose border with it is near, its own among them."""
        out = []
        for lo in range(0, len(x), 1024):
            here, mine = x[lo : lo + 1024], own[lo : lo + 1024]
            d, rows = squared(here, self.coarse), np.arange(len(here))
            between = squared(self.coarse[mine], self.coarse)
            along = np.maximum(squared(self.leaning[mine], self.leaning), between / x.shape[1])
            # (distance to the border) <= min(step / 2, spread / 2 x step x deviation), both sides times 2 x between
            reach = step * np.minimum(np.sqrt(between), spread * np.sqrt(along))
            near = d - d[rows, mine][:, None] <= reach + 1e-12
            near[rows, mine] = True
            out += [np.flatnonzero(n).astype(np.int32) for n in near]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Rows x subspaces x codes: what each code adds to the product."""
        return np.einsum("bmd,mkd->bmk", q.reshape(len(q), len(self.books), -1), self.books)


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f8" if dim < 0 else "<f4").reshape(len(column), abs(dim)).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows with `valid`, and the distinct valid vectors: cid, label, vector, least id, n."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    big = F.lit(float("inf"))
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("valid", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    one = rows.filter("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # A number of its own for each class: vectors that share an id are different classes. It stays once the table is written.
    return rows, one.withColumn("cid", F.monotonically_increasing_id())


def sampled(one: DataFrame, total: int, sample: int) -> dict[int, np.ndarray]:
    """About `sample` of all vectors, chosen by hash, as unit rows by dimension."""
    share = F.pmod(F.xxhash64(F.lit(7), "vector"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))
    column = one.filter(share).select(F.col("vector").cast("array<double>").alias("v")).toArrow().column("v").combine_chunks()
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    ends, out = np.cumsum(sizes), {}
    for dim in np.unique(sizes):
        x = np.stack([flat[e - dim : e] for e in ends[sizes == dim]])
        x = x[np.lexsort(x.T[::-1])]
        out[int(dim)] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.93, sample: int = 40_000, per_list: int = 400, subspaces: int = 8, codes: int = 256, spread: float = 4.0, chunk: int = 2000, few: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    There is a list for each `per_list` classes, but for no fewer than 16 vectors of the sample.
    """
    small_batches(vectors.sparkSession)
    rows, one = classes(vectors, id_col, vector_col, label_col)
    one = written(one, "vector-classes")
    wide = dict(one.dtypes)["vector"] == "array<double>"
    total = one.count()
    models = {dim: Quantiser.fit(x, max(1, min(total // per_list, len(x) // 16)), subspaces, codes) for dim, x in sampled(one, total, sample).items()}
    step = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def index(batches):
        for batch in batches:
            values = [np.array(v, "<f8" if wide else "<f4") for v in batch.column("vector").to_pylist()]
            sizes = np.array([len(v) for v in values], int)
            cid, n, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n", "label"))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                raw = [values[i].tobytes() for i in at]
                x = unpack(pa.array(raw, pa.binary()), -int(dim) if wide else int(dim))
                model = models.get(int(dim))
                if model is None:
                    place, code, left, reach = np.zeros(len(at), int), np.zeros((len(at), 0), np.uint8), np.zeros(len(at)), [[0]] * len(at)
                else:
                    place, code, left = model.encode(x)
                    reach = model.probes(x, place, step, spread)
                yield {
                    "label": label[at], "dim": np.full(len(at), dim), "list": place, "probes": reach, "cid": cid[at], "n": n[at],
                    "raw": raw, "code": [c.tobytes() for c in code], "left": left,
                }

    kind = dict(one.dtypes)["label"]
    entries = written(arrow_map(one.select("label", "vector", "cid", "n"), index, f"label {kind}, dim int, list int, probes array<int>, cid long, n long, raw binary, code binary, left double"), "vector-lists")
    # Lists with more entries or queries than a chunk holds; the others are one chunk of each.
    asked = entries.select("label", "dim", F.explode("probes").alias("list"), F.lit(0).alias("e")).unionByName(entries.select("label", "dim", "list", F.lit(1).alias("e")))
    sizes = asked.groupBy("label", "dim", "list").agg(F.ceil(F.sum("e") / chunk).alias("ec"), F.ceil(F.sum(1 - F.col("e")) / (8 * chunk)).alias("qc"))
    long_lists = written(sizes.filter("ec > 1 OR qc > 1"), "long-lists")
    side = F.broadcast(long_lists) if long_lists.count() <= few else long_lists
    keys = ["label", "dim", "list", "e", "q"]

    def dealt_as(rows: DataFrame, query: int) -> DataFrame:
        """Each row in its own chunk, against every chunk of the other kind."""
        mine, other = ("qc", "ec") if query else ("ec", "qc")
        at_least = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
        rows = rows.join(side, ["label", "dim", "list"], "left")
        rows = rows.withColumns({"mine": F.pmod(F.xxhash64("cid"), at_least(mine)), "other": F.explode(F.sequence(F.lit(0).cast("long"), at_least(other) - 1))})
        e, q = ("other", "mine") if query else ("mine", "other")
        return rows.select("label", "dim", "list", F.col(e).alias("e"), F.col(q).alias("q"), F.lit(query).alias("query"), "cid", "n", "raw", "code", "left", "own", "probes")

    queries = entries.withColumns({"own": F.col("list"), "list": F.explode("probes"), "code": F.lit(None).cast("binary"), "left": F.lit(0.0), "probes": F.lit(None).cast("array<int>")})
    dealt = dealt_as(entries.withColumn("own", F.col("list")), 0).unionByName(dealt_as(queries, 1)).repartition(*keys).sortWithinPartitions(*keys, "query")

    def search(batches):
        key, held = None, []
        state: dict = {}

        def finish():
            if not state.get("a"):
                return None
            a, b = np.concatenate(state["a"]), np.concatenate(state["b"])
            ids, at = np.unique(np.concatenate(state["ids"]), return_inverse=True)
            links = np.bincount(at, np.concatenate(state["links"]), len(ids)).astype(np.int64)
            x, y = local_forest(a, b)
            return {"a": np.concatenate([ids, x]), "b": pa.array([None] * len(ids) + y.tolist(), pa.int64()), "links": pa.array(links.tolist() + [None] * len(x), pa.int64())}

        def entry_arrays(tables):
            t = pa.Table.from_batches(tables)
            dim = -key[1] if wide else key[1]
            probes = t.column("probes").combine_chunks()
            owner = np.repeat(np.arange(t.num_rows), np.diff(probes.offsets.to_numpy()))
            return {
                # (entry, list that it probes itself) as one sorted number
                "probed": np.sort(owner << 32 | probes.flatten().to_numpy().astype(np.int64)),
                "x": unpack(t.column("raw").combine_chunks(), dim), "cid": t.column("cid").to_numpy(), "n": t.column("n").to_numpy(), "left": t.column("left").to_numpy(),
                "code": np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(t.num_rows, -1),
            }

        def ask(part):
            model, e = models.get(key[1]), state["entries"]
            q_all = unpack(part.column("raw"), -key[1] if wide else key[1])
            q_id, q_n, q_own = (part.column(c).to_numpy() for c in ("cid", "n", "own"))
            for lo in range(0, len(q_all), 256):
                q = q_all[lo : lo + 256]
                if model is None:
                    near = np.ones((len(q), len(e["cid"])), bool)
                else:
                    tables = model.tables(q)
                    estimate = (q @ model.coarse[key[2]])[:, None] + sum(tables[:, m][:, e["code"][:, m]] for m in range(e["code"].shape[1]))
                    near = estimate >= threshold - e["left"][None] - 1e-9
                # Within one list each pair shows up from both sides.
                near &= (q_id[lo : lo + 256][:, None] < e["cid"][None]) | (q_own[lo : lo + 256] != key[2])[:, None]
                i, j = np.nonzero(near)
                for s in range(0, len(i), 50_000):
                    a, b = i[s : s + 50_000], j[s : s + 50_000]
                    ok = np.einsum("ij,ij->i", q[a], e["x"][b]) >= threshold
                    a, b = a[ok], b[ok]
                    # The entry may probe the query's list too, and find the pair there: it counts from the lesser side.
                    back = b.astype(np.int64) << 32 | q_own[lo + a]
                    at = np.minimum(np.searchsorted(e["probed"], back), len(e["probed"]) - 1)
                    ok = (e["probed"][at] != back) | (q_id[lo + a] < e["cid"][b])
                    a, b = a[ok], b[ok]
                    if len(a):
                        state.setdefault("a", []).append(q_id[lo + a])
                        state.setdefault("b", []).append(e["cid"][b])
                        state.setdefault("ids", []).extend([q_id[lo + a], e["cid"][b]])
                        state.setdefault("links", []).extend([e["n"][b].astype(float), q_n[lo + a].astype(float)])
                        state["held"] = state.get("held", 0) + len(a)
                if state.get("held", 0) > 500_000:
                    yield finish()
                    for name in ("a", "b", "ids", "links", "held"):
                        state.pop(name)

        for batch in batches:
            ks = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            kinds = batch.column("query").to_pylist()
            lo = 0
            while lo < len(ks):
                hi = lo
                while hi < len(ks) and ks[hi] == ks[lo] and kinds[hi] == kinds[lo]:
                    hi += 1
                if ks[lo] != key:
                    if (out := finish()) is not None:
                        yield out
                    key, held, state = ks[lo], [], {}
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    held.append(part)
                elif held:
                    if "entries" not in state:
                        state["entries"] = entry_arrays(held)
                    yield from ask(part)
                lo = hi
        if (out := finish()) is not None:
            yield out

    found = written(arrow_map(dealt, search, "a long, b long, links long"), "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = components(found.filter("b is not null").select("a", "b"))
    rooted = one.join(counts, F.col("cid") == F.col("a"), "left").join(linked, F.col("cid") == F.col("node"), "left")
    rooted = rooted.select("label", "vector", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select("label", "vector", "n_links", "component_id")
    fine = rows.filter("valid").join(of_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fine.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
