"""The driver's contract, and that the engine stands without the training-data part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_import_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1]) > 50


def test_engine_doesnt_import_the_training_data_part():
    for path in (ROOT / "linkloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
