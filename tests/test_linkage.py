import pytest
from pyspark.sql import functions as F

from linkloom.functions.similarity import RATIOS
from linkloom.operators import blocking as B
from linkloom.operators import decide as D
from linkloom.operators import metrics as M
from linkloom.operators import pairs as C
from linkloom.operators import tfidf as V
from linkloom.operators import validate as Q
from linkloom.operators.features import ACCURACY, BASE, accuracy_features, base_features, with_ratios
from linkloom.operators.prepare import prepare, with_forms
from linkloom.sources import tsv

RECORD = "entity_id string, business_name string, business_address string, country string"
S1 = [("S1-1", "Acme Corporation", "12 Main Street, New York 10001", "US"), ("S1-2", "Boulangerie Dupont SARL", "3 rue de Lille, 75007 Paris", "FR"), ("S1-3", None, None, None), ("S1-4", "Infosys Technologies Private Limited", "Plot 45, Sector 18, Gurgaon 122015, Haryana", "India")]
OTHER = [("S2-1", "Acme Corp", "12 Main St New York 10001", "USA"), ("S2-2", "Boulangerie Dupond", "3 rue de Lille Paris 75007", ""), ("S3-1", "ACME Corp Ltd", "", "IN"), ("S3-2", "Infosys Tech Pvt. Ltd.", "Plot 45, Sector 18, Gurugram 122015", "in"), ("S3-3", "", "", "")]


@pytest.fixture(scope="module")
def sides(spark):
    return prepare(spark.createDataFrame(S1, RECORD)), prepare(spark.createDataFrame(OTHER, RECORD))


def truth(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, truth array<string>")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "s1_id string, cand_id string")


def test_blocking_equals_a_nested_loop(spark, sides):
    import math

    a, b = ([r.asDict() for r in s.collect()] for s in sides)
    want = set()
    for src in ("S2", "S3"):
        mine = [r for r in b if r["entity_id"].startswith(src)]
        df = {}
        for r in mine:
            for t in set(r["tokens"]):
                df[t] = df.get(t, 0) + 1
        most = max(10, int(len(mine) * 0.03))
        for x in a:
            scores = {}
            for y in mine:
                if x["country"] and y["country"] and x["country"] != y["country"]:
                    continue
                s = sum(math.log((len(mine) + 1) / (df[t] + 1)) + 1 for t in x["tokens"] if t in y["tokens"] and df[t] <= most)
                s += 3.0 * sum(n in y["nums"] + y["postals"] for n in set(x["nums"] + x["postals"]) if len(n) >= 4)
                if s >= 1.5:
                    scores[y["entity_id"]] = s
            top = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
            want |= {(x["entity_id"], k) for k, v in top if v >= max(1.5, 0.35 * top[0][1])}
    got = {(r[0], r[1]) for r in B.candidates(*sides).collect()}
    assert got == want
    assert ("S1-1", "S2-1") in got and ("S1-1", "S3-1") not in got  # a country conflict


def test_recall(spark, sides):
    t = truth(spark, [("S1-1", ["S2-1"]), ("S1-2", ["S2-2", "S3-9"]), ("S1-3", [])])
    row = B.recall(B.candidates(*sides), t).first()
    assert row["recall"] == pytest.approx(2 / 3) and row["true_pairs"] == 3
    assert B.recall(B.candidates(*sides), truth(spark, [("S1-3", [])])).first()["recall"] == 1.0


def features(spark, sides, rows):
    joined = C.join_records(pairs(spark, rows), with_forms(sides[0]), with_forms(sides[1]))
    return with_ratios(joined)


def test_features_are_complete_and_in_range(spark, sides):
    p = features(spark, sides, [(a[0], b[0]) for a in S1 for b in OTHER])
    assert len(BASE) == 25 and len(ACCURACY) == 58
    for df, names in ((base_features(p), BASE), (accuracy_features(p), ACCURACY)):
        rows = df.collect()
        assert len(rows) == len(S1) * len(OTHER) and df.columns[2:] == names
        for r in rows:
            for n in names:
                assert r[n] is not None and r[n] == r[n]
                if not any(x in n for x in ("count", "len_diff", "logit")) or n == "name_len_diff_ratio":
                    assert 0 <= r[n] <= 1


def test_indian_address(spark, sides):
    r = accuracy_features(features(spark, sides, [("S1-4", "S3-2")])).first()
    assert r["addr_postal_exact_match"] == 1.0 and r["addr_street_num_match"] == 1.0 and r["addr_numeric_overlap_count"] >= 2
    assert r["addr_token_jaccard"] > 0.4 and r["country_conflict"] == 1.0  # raw country, no aliases


@pytest.mark.parametrize("other, exact, conflict, guarded", [("FR", 1.0, 0.0, 0.92), ("US", 0.0, 1.0, 0.0), ("", 0.5, 0.0, 0.92)])
def test_open_set_country(spark, other, exact, conflict, guarded):
    a = prepare(spark.createDataFrame([("S1-1", "Boulangerie Dupont", "3 rue de Lille", "FR")], RECORD))
    b = prepare(spark.createDataFrame([("S2-1", "Boulangerie Dupont", "3 rue de Lille", other)], RECORD))
    f = accuracy_features(features(spark, (a, b), [("S1-1", "S2-1")]))
    r = f.withColumn("g", D.guarded(f, F.lit(0.92))).first()
    assert (r["country_exact_match"], r["country_conflict"], r["g"]) == (exact, conflict, guarded)


def test_guards(spark):
    low = spark.range(1).select(*[F.lit(0.1).alias(n) for n in ("name_levenshtein_sim", "addr_levenshtein_sim")])
    assert low.select(D.guarded(low, F.lit(0.60))).first()[0] == 0.0
    near = spark.range(1).select(F.lit(0.8).alias("name_levenshtein_sim"), F.lit(1.0).alias("addr_has_postal_a"), F.lit(1.0).alias("addr_has_postal_b"), F.lit(0.0).alias("addr_postal_exact_match"), F.lit(0.0).alias("addr_street_num_match"))
    assert near.select(D.guarded(near, F.lit(0.8))).first()[0] == pytest.approx(0.3)


def scores(spark, *values):
    return spark.createDataFrame([("S1-1", f"S2-{i}", float(v)) for i, v in enumerate(values)], "s1_id string, cand_id string, score double")


def test_decisions(spark):
    assert D.decide_reranked(scores(spark, 0.55, 0.40), 0.5, 0.1, 0.70).count() == 0
    assert {r["cand_id"] for r in D.decide_reranked(scores(spark, 0.88, 0.85), 0.5, 0.1, 0.70).collect()} == {"S2-0", "S2-1"}
    assert D.decide(scores(spark, 0.9, 0.72), 0.7, 0.1).count() == 1
    assert D.decide_reranked(scores(spark, 0.9, 0.72), 0.5, 0.1, 0.7).count() == 2  # sure enough without the margin


def test_macro_f05(spark):
    t = truth(spark, [("S1-1", ["S2-47", "S3-812"])])
    m = pairs(spark, [("S1-1", x) for x in ("S2-47", "S2-193", "S3-812")])
    assert M.macro_f05(t, m).first()["macro_f0_5"] == pytest.approx(0.7143, abs=1e-3)
    empty = m.limit(0)
    assert M.macro_f05(truth(spark, [("S1-1", [])]), empty).first()["macro_f0_5"] == 1.0
    assert M.macro_f05(truth(spark, [("S1-1", [])]), m).first()["macro_f0_5"] == 0.0
    assert M.macro_f05(t, empty).first()["macro_f0_5"] == 0.0


def test_grids_equal_single_decisions(spark):
    s = scores(spark, 0.9, 0.82, 0.5, 0.3).unionByName(scores(spark, 0.4).withColumn("s1_id", F.lit("S1-2")))
    t = truth(spark, [("S1-1", ["S2-0", "S2-2"]), ("S1-2", []), ("S1-3", ["S2-9"])])
    two, three = M.grid_2d(s, t).collect(), M.grid_3d(s, t).collect()
    assert (len(two), len(three)) == (232, 273)
    for r in two[::37]:
        assert M.full_metrics(t, D.decide(s, r["threshold"], r["margin"])).first()["macro_f0_5"] == pytest.approx(r["macro_f0_5"])
    for r in three[::61]:
        assert M.full_metrics(t, D.decide_reranked(s, r["threshold"], r["margin"], r["hurdle"])).first()["n_tp"] == r["n_tp"]
    assert M.best_3d(M.grid_3d(s, t))["macro_f0_5"] == pytest.approx(max(r["macro_f0_5"] for r in three), abs=1e-4)


def test_tfidf(spark):
    rows = spark.createDataFrame([("a", "acme widgets"), ("b", "acme widgets"), ("c", "zeta"), ("d", ""), ("e", "")], "entity_id string, x string")
    vectors = V.transform(rows, "entity_id", "x", V.fit(rows, "x"))
    got = {(r[0], r[1]): r[2] for r in V.cosines(pairs(spark, [("a", "b"), ("a", "c"), ("d", "e")]), vectors, vectors, "v").collect()}
    assert got[("a", "b")] == pytest.approx(1.0, abs=1e-4) and got[("a", "c")] == 0.0 and got[("d", "e")] == pytest.approx(1.0)


def test_md5_fold_equals_whole_number_modulo(spark):
    import hashlib

    ids = [f"S1-{i:05d}" for i in range(50)]
    for n in (2, 5, 7):
        got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(C.md5_fold(F.col("x"), n)).collect()]
        assert got == [int(hashlib.md5(x.encode()).hexdigest(), 16) % n for x in ids]


def test_cap_negatives(spark):
    labelled = spark.createDataFrame([("S1-1", f"S2-{i}", int(i < 2)) for i in range(30)], "s1_id string, cand_id string, label int")
    assert C.cap_negatives(labelled, 3.0).groupBy().agg(F.sum("label"), F.count("*")).first()[:] == (2, 8)
    assert C.cap_negatives(labelled.filter("label = 0"), 3.0).count() == 28


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-1\tA "b" c\t\tUS\t1\n', encoding="utf-8")
    row = tsv.read_source(spark, str(path)).first()
    assert row["business_address"] == "" and row["country"] == "US"
    bad = tmp_path / "b.tsv"
    bad.write_text("entity_id\tx\n", encoding="utf-8")
    with pytest.raises(ValueError, match="country"):
        tsv.read_source(spark, str(bad))
    entities = pairs(spark, [("S1-1", ""), ("S1-2", "")])
    lists = tsv.matching_results(entities, pairs(spark, [("S1-1", "S2-2"), ("S1-1", "S2-1"), ("S1-1", "S2-2")]))
    assert {tuple(r) for r in lists.collect()} == {("S1-1", "S2-1,S2-2"), ("S1-2", "")}
    out = str(tmp_path / "out")
    tsv.write_id_lists(lists.repartition(2), out)
    again = tsv.truth_lists(tsv.read_ground_truth(spark, out))
    assert {r[0]: r[1] for r in again.collect()} == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}
    tsv.write_id_file(lists.repartition(2), str(tmp_path / "one.tsv"))
    lines = (tmp_path / "one.tsv").read_text(encoding="utf-8").splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and sorted(lines[1:]) == ["S1-1\tS2-1,S2-2", "S1-2\t"]
    tsv.write_id_file(lists, str(tmp_path / "one.tsv"))
    assert [p.name for p in tmp_path.iterdir() if "one.tsv" in p.name and not p.name.endswith(".crc")] == ["one.tsv"]
    tsv.write_thresholds(spark, str(tmp_path / "t"), 0.6, 0.1)
    assert tsv.read_thresholds(spark, str(tmp_path / "t")) == {"threshold": 0.6, "margin": 0.1, "hurdle": 0.6}
    tsv.write_thresholds(spark, str(tmp_path / "t"), 0.6, 0.1, 0.7)
    assert tsv.read_thresholds(spark, str(tmp_path / "t"))["hurdle"] == 0.7


@pytest.mark.parametrize(
    ("row", "broken", "name"),
    [
        ('S1-1\t"A ""b"" c"\t\tUS', False, 'A "b" c'), ("S1-1\tA 5\" c\t\tUS", False, 'A 5" c'), ("S1-1\t\t\t", False, ""), ('S1-1\t"A\nb"\tx\tUS', True, "A\nb"),
        ('S1-1\t"A\tb"\tx\tUS\r', False, "A\tb"), ('S1-1\tA 5" c\t"x\ny"\tUS', True, 'A 5" c'), ("S1-1\t" + "a" * 200_000 + "\t\tUS", False, "a" * 200_000),
    ],
)
def test_lines_are_read_one_by_one_unless_a_field_breaks(spark, tmp_path, row, broken, name):
    path = tmp_path / "s.tsv"
    path.write_bytes(f"entity_id\tbusiness_name\tbusiness_address\tcountry\n{row}\n".encode())
    assert tsv.breaks_lines(spark, str(path)) is broken
    assert [r["business_name"] for r in tsv.read_source(spark, str(path)).collect()] == [name]


def test_validator(spark, tmp_path):
    m, c = tmp_path / "m.tsv", tmp_path / "c.tsv"
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\t\nS1-9\tX-1\n\tS2-1\nS1-2\ta\tb\n", encoding="utf-8")
    c.write_text("wrong\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n", encoding="utf-8")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    others = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {(r["file"], r["rule"]) for r in Q.validate_files(spark, str(m), str(c), ids, others).collect()}
    assert got == {("matching", r) for r in ("duplicate_in_list", "duplicate_id", "unknown_id", "prefix", "unknown_match", "empty_id", "columns", "missing_entity", "not_a_candidate")} | {("candidate", "header")}
    m.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n", encoding="utf-8")
    c.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n", encoding="utf-8")
    assert Q.passes(Q.validate_files(spark, str(m), str(c), ids, others))


def test_validator_takes_folders_of_files(spark, tmp_path):
    """Each part has a header; small blocks cut files, and lines keep their numbers."""
    n = 300
    entities = pairs(spark, [(f"S1-{i}", "") for i in range(n)])
    found = pairs(spark, [(f"S1-{i}", f"S2-{i}") for i in range(n)])
    m, c = str(tmp_path / "m"), str(tmp_path / "c")
    tsv.write_id_lists(tsv.matching_results(entities, found).repartition(3), m)
    tsv.write_id_lists(tsv.candidate_pairs(entities, found).repartition(2), c)
    ids, others = entities.select(F.col("s1_id").alias("entity_id")), found.select(F.col("cand_id").alias("entity_id"))
    assert Q.passes(Q.validate_files(spark, m, c, ids, others))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert Q.passes(Q.validate_files(spark, m, c, ids, others))
        lines = Q.numbered_lines(spark, m).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [v for p in sorted((tmp_path / "m").glob("part-*")) for v in p.read_text(encoding="utf-8").splitlines()]
    assert [r["line"] for r in lines] == list(range(1, n + 4)) and [r["value"] for r in lines] == want
    assert [r["value"] for r in lines if r["head"]] == ["source1_entity_id\tmatched_entity_ids"] * 3


def test_stream_gives_what_a_batch_gives(spark, sides, tmp_path):
    from linkloom.streaming.blocking import candidates_of_stream

    spark.createDataFrame(S1, RECORD).write.parquet(str(tmp_path / "in"))
    query = candidates_of_stream(spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")), sides[1], str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    got = {(r[0], r[1]) for r in spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id").collect()}
    assert got == {(r[0], r[1]) for r in B.candidates(*sides).collect()}
