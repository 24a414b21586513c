"""The pipeline's stages, each written and read again, and that the rest stands without this part."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if k < 2:
            assert all(first[r["doc_id"]] == r["text"] for r in docs.collect())
    assert len(first) > counts[0] > counts[1] == counts[2]
    assert corpus_pipeline.run(spark, DATA).count() == counts[-1]


def test_rest_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
