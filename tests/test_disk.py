"""What the linkage queries move between tasks, and so put on disk."""

import random

import pytest
from pyspark.sql import functions as F
from test_scale import side

from linkloom.operators import blocking as B
from linkloom.operators import cells
from linkloom.operators import decide as D
from linkloom.operators import metrics as M
from linkloom.operators import pairs as C
from linkloom.operators.features import ACCURACY, accuracy_features
from linkloom.plans import catalogue
from linkloom.sources import views


def bytes_shuffled(spark, df):
    """Bytes that the stages of df write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(store.lastStageAttempt, range(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).size()))}
    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("made", [views.records, views.truth])
def test_first_lines_are_not_shuffled(spark, tmp_path, made):
    chance = random.Random(1)
    lines = ["".join(chance.choices("abcdefgh ", k=20_000)) for _ in range(30)]
    spark.createDataFrame([(i, lines[i % 30] + "\nmore", "en") for i in range(90)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert 0 < bytes_shuffled(spark, made(spark, str(tmp_path))) < 30_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_truth_has_each_reference_and_the_others_of_its_line(spark, tmp_path):
    # 1 and 2 share a line that has no reference; 9 is a later document of the line of 3.
    texts = {0: "Alpha\nx", 1: "lone", 2: "LONE", 3: "beta", 4: "alpha", 5: "BETA\ny", 6: None, 9: "beta", 12: "alpha ", 15: ""}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    truth = views.truth(spark, str(tmp_path))
    assert {tuple(r) for r in M.true_pairs(truth).collect()} == {("S1-0", "S2-4"), ("S1-3", "S3-5"), ("S1-3", "S3-9"), ("S1-6", "S3-15")}
    assert {tuple(r) for r in M.true_sizes(truth).collect()} == {("S1-0", 1), ("S1-3", 2), ("S1-6", 1), ("S1-12", 0)}


def test_decisions_group_pairs_where_they_lie(spark):
    a, b = side(spark, "S1", 12), side(spark, "S2", 20)
    found = spark.createDataFrame([(f"S1-{i}", f"S2-{i + j}", 1.0) for i in range(12) for j in range(3)], cells.SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = C.join_records(found, a, b)
        plans = [x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for x in (pairs, D.decide(pairs, 0.6, 0.1), D.decide_reranked(pairs, 0.6, 0.1, 0.6))]
        assert plans == [4, 4, 4]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def prepared_run(spark):
    run = catalogue.Run(spark, "")
    rows = side(spark, "S1", 12).unionByName(side(spark, "S2", 20))
    run.__dict__.update(records=rows, found=spark.createDataFrame([(f"S1-{i}", f"S2-{i + j}", 1.0) for i in range(12) for j in range(3)], cells.SCHEMA))
    return run


def test_pairs_move_only_the_fields_that_features_read(spark):
    run = prepared_run(spark)
    of = lambda df: {x for s in ("a", "b") for x in df.select(f"{s}.*").columns}
    assert of(run.pairs_for(["name_base_levenshtein_sim", "addr_token_jaccard"])) == {"base", "addr", "addr_words"}
    everything = run.pairs_for(ACCURACY)
    assert not {"name", "country", "entity_id"} & of(everything) and {"nums", "postals"} <= of(everything)


def test_each_feature_is_the_same_with_its_fields_alone(spark):
    run = prepared_run(spark)
    whole = {tuple(r[:2]): r for r in accuracy_features(catalogue.without_ratios(run.pairs)).collect()}
    for name in ("addr_postal_jaccard", "name_addr_min_sim", "addr_street_num_match"):
        accuracy_features(catalogue.without_ratios(run.pairs_for([name])), [name]).schema  # noqa: B018 - it resolves
    got = accuracy_features(catalogue.without_ratios(run.pairs_for(ACCURACY))).collect()
    assert len(got) == len(whole) == 36 and all(whole[tuple(r[:2])] == r for r in got)


@pytest.mark.parametrize("made", [M.grid_2d, M.grid_3d])
def test_grids_count_scores_at_and_above_the_least_threshold(spark, made):
    scored = spark.createDataFrame([(f"S1-{i}", f"S2-{i}-{j}", 0.01) for i in range(400) for j in range(10)] + [("S1-0", "S2-x", 0.9), ("S1-1", "S2-y", 0.3), ("S1-z", "S2-x", 0.9)], cells.SCHEMA).repartition(2, "s1_id")
    truth = spark.createDataFrame([("S1-0", "S2-x"), ("S1-1", None), ("S1-2", "S2-2-0")], "s1_id string, cand_id string")
    first = made(scored, truth).orderBy("threshold", "margin").first()
    assert (first["n_entities"], first["n_tp"], first["n_fn"], first["n_predicted_matches"]) == (3, 1, 1, 2 if made is M.grid_2d else 1)


def test_equal_scores_of_a_reference_are_one_run(spark, monkeypatch):
    monkeypatch.setattr(cells, "BATCH", 7)
    a, b = side(spark, "S1", 30, ("US",)), side(spark, "S2", 200, ("US",))
    of = {}
    for r in B.name_scores(a, b, 1.0).collect():
        of.setdefault(r["s1_id"], []).append((r["score"], r["cand_id"]))
    assert sum(map(len, of.values())) == B.name_hits(a, b, 1.0).select("s1_id", "cand_id").distinct().count() > 1_000
    assert all([s for s, _ in rows] == sorted((s for s, _ in rows), reverse=True) for rows in of.values())


def test_all_pairs_of_a_part_have_ids_for_one_dictionary(spark, monkeypatch):
    monkeypatch.setattr(cells, "LISTED", 1_000, raising=False)
    a, b = side(spark, "S1", 3, ("US",)), side(spark, "S2", 3_000, ("US",))
    parts = [{r["cand_id"] for r in part} for part in B.name_scores(a, b, 1.0).rdd.glom().collect()]
    everyone = set().union(*parts)
    assert len(everyone) == B.name_hits(a, b, 1.0).select("cand_id").distinct().count() > 2_000
    assert sum(map(len, parts)) == len(everyone) and max(map(len, parts)) < 1_200


def test_name_scores_store_only_what_blocking_reads(spark, monkeypatch):
    raw = spark.createDataFrame([(f"S{s}-{i}", f"harbour {i % 3} north", f"{i} Main Street", "US") for s in (1, 2, 3) for i in range(12)], "entity_id string, business_name string, business_address string, country string")
    held, keep = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df: held.append(df.columns) or keep(df))
    monkeypatch.setattr(catalogue.R, "records", lambda *_: raw)
    assert catalogue.QUERIES["block_name_scores"](spark, "").count()
    assert held == [["entity_id", "country", "tokens"]]
