"""Training to result lists over the derived records."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import model as L
from linkloom.operators.prepare import prepare
from linkloom.plans import runs
from linkloom.sources import tsv
from linkloom.sources import views as R

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    a, b = prepare(R.source(spark, DATA, 1)), prepare(R.source(spark, DATA, 2, 3))
    t = R.truth(spark, DATA)
    return a, b, t, runs.train_baseline(a, b, t)


def test_baseline(spark, trained, tmp_path):
    a, b, t, base = trained
    assert base.scored.agg(F.min("score"), F.max("score")).filter("`min(score)` >= 0 and `max(score)` <= 1").count() == 1
    L.save(base.model, str(tmp_path / "m"))
    assert L.importance(L.load(str(tmp_path / "m")), 3) == L.importance(base.model, 3)
    found, matches = runs.predict_matches(base, a, b)
    assert matches.select("s1_id", "cand_id").subtract(found).count() == 0


def test_reranker(spark, trained, tmp_path):
    a, b, t, base = trained
    final = runs.train_reranker(base, a, b, t, kind="logistic")
    runs.save(spark, str(tmp_path / "run"), base, final)
    again = runs.load_reranker(spark, str(tmp_path / "run"))
    assert (again.threshold, again.margin, again.hurdle) == (final.threshold, final.margin, final.hurdle)
    found, matches = runs.predict_matches(runs.load_baseline(spark, str(tmp_path / "run")), a, b, again)
    assert matches.select("s1_id", "cand_id").subtract(found).count() == 0
    assert final.scored.filter("score < 0 or score > 1").count() == 0
    rows = {r["stage"]: r["macro_f0_5"] for r in runs.report(base, final, t).collect()}
    assert set(rows) == {"baseline", "ml", "ensemble"} and all(0 <= v <= 1 for v in rows.values())


def test_command_line(spark, tmp_path, capsys):
    """Train, predict, validate and evaluate over files; results pass the validator, and broken ones don't."""
    from linkloom.__main__ import parser

    def run(*args):
        parsed = parser().parse_args([str(a) for a in args])
        return parsed.run(spark, parsed)

    files = {n: tmp_path / n for n in ("s1", "s2", "s3", "truth", "model", "out")}
    for name, which in (("s1", 1), ("s2", 2), ("s3", 3)):
        R.source(spark, DATA, which).write.csv(str(files[name]), sep="\t", header=True, escape='"', emptyValue="")
    lists = tsv.matching_results(R.source(spark, DATA, 1).select(F.col("entity_id").alias("s1_id")), R.truth(spark, DATA).filter("cand_id IS NOT NULL"))
    tsv.write_id_lists(lists, str(files["truth"]))
    sources = ["--references", files["s1"], "--others", files["s2"], files["s3"]]
    assert run("train", *sources, "--truth", files["truth"], "--model", files["model"]) == 0
    assert run("predict", *sources, "--model", files["model"], "--out", files["out"], "--one-file") == 0
    results = ["--matching", files["out"] / "matching_results.tsv", "--candidate", files["out"] / "candidate_pairs.tsv"]
    assert run("validate", *sources, *results) == 0
    assert run("evaluate", "--truth", files["truth"], *results[:2]) == 0
    assert "macro_f0_5" in capsys.readouterr().out
    with (files["out"] / "matching_results.tsv").open("a", encoding="utf-8") as f:
        f.write("S1-none\tX-1\n")
    (files["out"] / ".matching_results.tsv.crc").unlink(missing_ok=True)
    assert run("validate", *sources, *results) == 1
    assert "unknown_id" in capsys.readouterr().out
