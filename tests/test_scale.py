"""What is moved between tasks grows with records and results, not with the hits between them."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import blocking as B
from linkloom.operators import cells
from linkloom.operators import decide as D
from linkloom.operators import pairs as C
from linkloom.operators.prepare import prepare, with_forms
from linkloom.plans import catalogue, runs

RECORD = "entity_id string, business_name string, business_address string, country string"
NAMES = ["north harbour trading", "north harbour", "harbour trading house", "trading trading north", "old mill", "mill house north", ""]


def side(spark, source, n, countries=("US", "FR", "", "DE")):
    return prepare(spark.createDataFrame([(f"{source}-{i}", NAMES[i % 7], f"{i % 5} Main Street {10000 + i % 3}", countries[i % len(countries)]) for i in range(n)], RECORD))


def rounded(df):
    return sorted((r["s1_id"], r["cand_id"], round(r["score"], 6)) for r in df.collect())


def shuffled(spark, df):
    """Rows that the stages of df write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(store.lastStageAttempt, range(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None).size()))}
    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


def with_null_country(df):
    return df.withColumn("country", F.when(F.substring_index("entity_id", "-", -1).cast("int") % 11 == 3, None).otherwise(F.col("country")))


@pytest.mark.parametrize("small", [1, 2_000])
def test_sums_equal_hits_as_rows(spark, monkeypatch, small):
    for name, value in {"SMALL": small, "CHUNK": 9, "LEAST": 2, "BATCH": 7}.items():
        monkeypatch.setattr(cells, name, value)
    a, b = (with_null_country(x) for x in (side(spark, "S1", 45), side(spark, "S2", 60).unionByName(side(spark, "S3", 30, ("US", "", "IN")))))
    want = rounded(B.best(B.scores(a, b, 1.0)))
    assert want and rounded(B.candidates(a, b, most_share=1.0)) == want
    assert rounded(B.name_scores(a, b, 1.0)) == rounded(B.name_hits(a, b, 1.0).groupBy("s1_id", "cand_id").agg(F.sum("score").alias("score")))
    assert B.candidates(a.limit(0), b).count() == B.candidates(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("made", [B.candidates, B.name_scores])
def test_hits_are_not_shuffled(spark, made):
    a, b = side(spark, "S1", 400, ("US",)), side(spark, "S2", 400, ("US",))
    pairs = B.name_hits(a, b, 1.0).select("s1_id", "cand_id").distinct().count()
    assert pairs > 50_000
    assert shuffled(spark, made(a, b, most_share=1.0)) < pairs / 3


def forms_moved(df):
    """Lines of the plan below its first exchange that make 3-grams."""
    below = df.select("s1_id", "a.full3", "b.full3")._jdf.queryExecution().executedPlan().toString().split("\n")
    first = next(i for i, line in enumerate(below) if "Exchange" in line)
    return [line for line in below[first:] if "array_distinct(transform(" in line]


def test_forms_are_made_behind_the_shuffles(spark):
    a, b = side(spark, "S1", 12), side(spark, "S2", 20)
    found = spark.createDataFrame([(f"S1-{i}", f"S2-{i + j}", 1.0) for i in range(12) for j in range(3)], cells.SCHEMA)
    got = C.each_side(C.join_records(found, a.drop("tokens"), b.drop("tokens")), with_forms)
    want = C.join_records(found, with_forms(a), with_forms(b))
    fields = [F.struct(*[F.col(f"{s}.{n}") for n in with_forms(a).columns]).alias(s) for s in "ab"]
    assert got.columns == want.columns
    assert not got.select("s1_id", "cand_id", *fields).exceptAll(want.select("s1_id", "cand_id", *fields)).count() and got.count() == want.count() == 36
    run = catalogue.Run(spark, "")
    run.__dict__.update(records=a.unionByName(b), found=found)
    assert not forms_moved(run.pairs)
    assert forms_moved(want)


def test_runs_store_no_forms(spark, monkeypatch):
    held = []
    keep = runs.stored
    monkeypatch.setattr(runs, "stored", lambda df: held.append(df.schema.simpleString()) or keep(df))
    pairs = runs.pair_table(side(spark, "S1", 12), side(spark, "S2", 20))
    assert pairs.count() and "full3" in pairs.select("a.*").columns
    assert len(held) == 2 and not any("full3" in x for x in held)


#: The queries over closed-form scores.
SCORED = ["decide_base", "decide_rerank", "blend_ml", "blend_ensemble", "guard_scores", "entity_f05", "macro_f05", "full_metrics", "grid_2d", "grid_3d", "grid_best", "matching_lists"]


@pytest.mark.parametrize("name", SCORED)
def test_scored_queries_make_and_store_only_what_they_read(spark, monkeypatch, name):
    raw = spark.createDataFrame([(f"S{s}-{i}", NAMES[i % 7], f"{i % 5} Main Street {10000 + i % 3}", "US") for s in (1, 2, 3) for i in range(12)], RECORD)
    held, keep = [], catalogue.stored
    monkeypatch.setattr(catalogue, "stored", lambda df: held.append(df.columns) or keep(df))
    monkeypatch.setattr(catalogue.R, "records", lambda *_: raw)
    monkeypatch.setattr(catalogue.R, "truth", lambda *_: raw.filter("entity_id LIKE 'S1-%'").select(F.col("entity_id").alias("s1_id"), F.concat(F.lit("S2-"), F.substring("entity_id", 4, 9)).alias("cand_id")))
    query = catalogue.QUERIES[name](spark, "")
    assert not [c for c in held if "score" in c and len(c) > 3], "features are stored"
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    plan = query._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "levenshtein(" in plan and "concat_ws(" not in plan and not any(f"{n}, array_distinct(" in plan for n in ("full3", "full4", "addr3", "addr4"))


def read_features(made):
    """The features that made, a function over scores with all features, asks for."""
    asked = set()

    class Scores:
        @property
        def columns(self):
            return self

        def __contains__(self, name):
            return asked.add(name) or True

    made(Scores())
    return asked


def test_blends_and_guards_name_the_features_that_they_read(spark):
    assert read_features(D.blend_ensemble) == set(D.BLENDED)
    assert read_features(lambda s: D.guarded(s, F.lit(0.5))) == set(D.GUARDED)
