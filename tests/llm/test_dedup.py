import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from linkloom.llm.components import components, local_forest
from linkloom.llm.simhash import allocate, bit_statistics, fingerprint, near_duplicates, probes, signed
from linkloom.llm import wide_simhash
from linkloom.llm.substrings import Bundle, Shape, bits, flags, remove_repeats, unpack
from linkloom.llm.vectors import Quantiser, near_vectors, nearest
from pyspark.sql import functions as F


def rooted(nodes, edges):
    label = {n: n for n in nodes}
    while True:
        was = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == was:
            return label


def test_components_against_a_plain_loop(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(500, 501 + i) for i in range(40)] + [(7, 7)]
    want = rooted({x for e in edges for x in e}, edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    x, y = local_forest(a, b)
    assert rooted(want, list(zip(x.tolist(), y.tolist(), strict=True))) == want and len(x) < len(want)


def brute_fingerprint(text):
    import re

    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    each = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_brute_force(docs, texts, nothing):
    got = sorted((r["fingerprint"], -1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect())
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in texts]
    codes = sorted({f for _, f in prints})
    label = rooted(codes, [(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in prints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    assert got == sorted((f"{f:016x}", -1 if i is None else i, least.get(label[f])) for i, f in prints)
    assert near_duplicates(nothing).count() == 0


def test_upper_case_beyond_ascii_stays():
    assert fingerprint("ÀB c d e") == brute_fingerprint("Àb C D E") != fingerprint("àb c d e")


def test_pigeonhole_loses_no_pair(spark):
    """Codes planted at 0 to 5 differing bits share a bucket whenever they differ in at most 3, for skewed and correlated bits."""
    rng = np.random.default_rng(3)
    codes = set()
    for _ in range(150):
        x = int(rng.integers(0, 1 << 62)) & 0x0FFF_FFFF_0000_FFFF
        codes |= {x, *(x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in range(1, 6))}
    df = spark.createDataFrame([(signed(c),) for c in codes], "code long")
    n, together = bit_statistics(df)
    assert n == len(codes)
    options = [allocate(n, together, 3), allocate(n, together, 3, row_cost=0.0), allocate(10**9, together / n * 10**9, 3)]
    for groups, thresholds in options:
        assert sorted(b for g in groups for b in g) == list(range(64)) and sum(t + 1 for t in thresholds) == 4
    for groups, thresholds in [options[0], options[2], (options[0][0][:0] + [list(range(0, 20)), list(range(20, 64))], [0, 2][::-1])]:
        buckets = {}
        for r in probes(df, groups, thresholds).collect():
            buckets.setdefault((r["part"], r["key"]), ([], []))[r["probe"]].append(r["code"] % (1 << 64))
        met = {frozenset((a, b)) for own, probing in buckets.values() for a in own for b in own + probing if a != b}
        want = {frozenset((a, b)) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 3}
        assert want <= met


def test_large_buckets_are_cut_without_loss(spark):
    from linkloom.llm.buckets import verified

    rng = np.random.default_rng(1)
    base = 0x5A5A_0000_FFFF_1234
    codes = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))})
    df = spark.createDataFrame([(0, 0, signed(c), 0) for c in codes], "part int, key long, code long, probe int")
    want = rooted([signed(c) for c in codes], [(signed(a), signed(b)) for a in codes for b in codes if (a ^ b).bit_count() <= 2])
    for chunk in (7, 50, 10_000):
        edges = [tuple(r) for r in verified(df, 2, chunk).collect()]
        assert rooted(want, edges) == want


def brute_windows(texts, width):
    ws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [3, 35])
def test_substrings_against_brute_force(docs, texts, nothing, width):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs, width, bundle_bytes=20_000).collect())
    want = Counter((i, *x) for (i, *_), x in zip(texts, brute_windows([t for _, t, *_ in texts], width), strict=True))
    assert got == want
    assert sum(x[2] * n for x, n in want.items()) > 0
    assert remove_repeats(nothing).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 30] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.35])], i % 3) for i in range(600)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (None, rows[3][1], 0), (1008, [float("inf")] * 16, 0), (5, rows[5][1], 2), (7, rows[8][1], 1), (7, rows[9][1], 1), (7, rows[9][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = Counter(tuple(r) for r in near_vectors(df, chunk=40, per_list=20).select("vec_id", "n_links", "component_id", "kept").collect())
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows + odd if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = [v / np.linalg.norm(v) for _, v, _ in good]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    label, n = rooted(range(len(good)), links), Counter(x for e in links for x in e)
    least = {}
    for k, (i, *_) in enumerate(good):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    want = Counter((i, n[k], least.get(label[k]), i is not None and least.get(label[k]) == i) for k, (i, *_) in enumerate(good))
    bad = [(i, 0, i, i is not None) for i, v, lab in rows + odd if not (v and lab is not None and None not in v and np.isfinite(v).all() and any(v))]
    assert got == want + Counter(bad)
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["even", "1/i", "rank 10"])
def test_probes_reach_neighbours_of_uneven_vectors(shape):
    """Share of planted neighbours that either side's probes reach, for vectors that are spread evenly, along few directions, or by falling variances."""
    rng = np.random.default_rng(6)
    dim = 96
    root = {"even": np.eye(dim), "1/i": np.diag(1 / np.arange(1, dim + 1)), "rank 10": rng.normal(size=(10, dim))}[shape]
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, len(root))) @ root)
    model = Quantiser.fit(x, 128, 8, 32)
    for noise in (rng.normal(size=(3000, len(root))) @ root, rng.normal(size=(3000, dim))):
        # neighbours at a cosine of 0.93 to 0.95
        side = unit(noise - (noise * x[:3000]).sum(1)[:, None] * x[:3000])
        cos = rng.uniform(0.93, 0.95, 3000)[:, None]
        y = cos * x[:3000] + np.sqrt(1 - cos**2) * side
        a, b = nearest(x[:3000], model.coarse), nearest(y, model.coarse)
        there, back = (model.probes(v, own, float(np.sqrt(2 - 2 * 0.93)), 4.0) for v, own in ((x[:3000], a), (y, b)))
        assert np.mean([j in p or i in r for i, j, p, r in zip(a, b, there, back, strict=True)]) >= 0.99


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def by_similarity(rows, least=0.8):
    """Root of each row under links of a shingle similarity of at least `least`; rows without words are one class."""
    sets = [shingles(t) for t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))]
    return rooted(range(len(rows)), links)


def test_one_of_each_against_brute_force(spark, docs, texts, nothing):
    """Groups by exact similarity, the least id of each stays once; names that the operator uses itself do no harm."""
    rng = random.Random(4)
    planted = []
    for i in range(60):
        ws = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(rng.randint(60, 400))]
        planted.append((1000 + 10 * i, " ".join(ws)))
        for k in range(1, 4):  # 1 to 3 in 100 words changed: similarities from 0.95 to 0.7
            planted.append((1000 + 10 * i + k, " ".join("new" if rng.random() < k / 100 else w for w in ws)))
    more = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True).withColumns({"text_key": F.lit(1), "cid": F.lit(2)})
    rows = [(i, t) for i, t, *_ in texts] + planted
    root = by_similarity([t for _, t in rows])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    left = wide_simhash.one_of_each(more)
    assert left.columns == more.columns
    got = Counter(r["doc_id"] for r in left.collect())
    want = set(least.values())
    assert max(got.values()) == 1 and want <= set(got)
    # links found, of all that brute force has: at least 0.9 of them at similarities just above 0.8, and none that it hasn't
    assert len(set(got) - want) <= 0.05 * len(planted)
    assert wide_simhash.one_of_each(nothing).count() == 0


def test_near_links_are_the_same_on_every_run(spark):
    """Links that the forests keep follow the codes: rows in other orders and partitions give the same pairs of texts."""
    rng = random.Random(9)
    rows = []
    for i in range(30):
        ws = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 400)) for _ in range(120)]
        rows += [(100 * i + k, " ".join("new" if rng.random() < 0.02 else w for w in ws)) for k in range(12)]
    runs = []
    for parts, seed in ((1, 0), (5, 1), (3, 2)):
        random.Random(seed).shuffle(rows)
        codes = wide_simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 5, 8, "doc_id", "text")
        # another number for each code in each run
        one = codes.groupBy("code").agg(F.min("doc_id").alias("doc_id")).withColumn("cid", F.xxhash64(F.lit(seed), "code")).cache()
        n, together = wide_simhash.bit_statistics(one, 8)
        found = wide_simhash.candidates(wide_simhash.probes(one, *wide_simhash.allocate(n, together, 0.8, 0.95)), 90, chunk=5)
        names = {r["cid"]: r["doc_id"] for r in one.select("cid", "doc_id").collect()}
        runs.append({(*sorted((names[r["a"]], names[r["b"]])), r["bits"]) for r in found.collect()})
        one.unpersist()
    assert len(runs[0]) > 200 and runs[0] == runs[1] == runs[2]


def test_spanning_forest_takes_the_least_edges():
    rng = np.random.default_rng(8)
    a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300)
    at = wide_simhash.spanning(a, b, np.argsort(w, kind="stable"))
    label, want = {i: i for i in range(40)}, 0
    for k in np.argsort(w, kind="stable"):
        x, y = label[a[k]], label[b[k]]
        if x != y:
            want += w[k]
            label = {i: (x if r == y else r) for i, r in label.items()}
    assert w[at].sum() == want and len(at) == len(set(rooted(range(40), list(zip(a, b, strict=True))))) - len(set(label.values()))


def test_windows_that_repeat_within_themselves(spark):
    """Words that repeat at once, so that anchors tie, a text of one long word, and odd spaces."""
    rows = ["x " * 80, "a b " * 30 + "tail", "w" * 3_000_000, "one\x0b two\r\n three " * 12, "", None, " ".join(str(i) for i in range(200)), " ".join(str(i) for i in range(150, 400)), "\x85 \u2003é " * 40]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(df).collect())
    assert got == Counter((i, *x) for i, x in enumerate(brute_windows(rows, 35)))


def test_estimates_are_never_below_the_counts():
    """A sketch far too narrow for its anchors still suspects every repeated window."""
    rng = random.Random(2)
    shared = " ".join(rng.choice("abcdefgh") for _ in range(60))
    texts = [" ".join([*(str(rng.randint(0, 10**6)) for _ in range(50)), shared if i % 2 else "", *(str(rng.randint(0, 10**6)) for _ in range(50))]) for i in range(40)]
    shape = Shape(35, 1000)
    shape.sketch = shape.range = 10
    bundles = [Bundle(texts[:20], shape), Bundle(texts[20:], shape)]
    sketches = [{(k, r): (c, t) for k, r, c, t in b.sketch()} for b in bundles]
    counts = {}
    for s in sketches:
        for key, (cells, twice) in s.items():
            total = counts.setdefault(key, np.zeros(1 << 10, int))
            cells = unpack(cells)
            total[cells] += 1 + flags(twice, len(cells))
    for b, s, part in zip(bundles, sketches, (texts[:20], texts[20:]), strict=True):
        got = set(b.suspect({key: bits(counts[key][unpack(c)] > 1) for key, (c, _) in s.items()}).tolist())
        for k, t in enumerate(part):
            at = t.split()
            want = [i for i in range(len(at) - 34) if " ".join(at[i : i + 35]) in shared]
            assert {int(b.first[k]) + i for i in want} <= got
