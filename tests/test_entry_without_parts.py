"""The library without its optional part: the folders are gone, the entry points still work."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
from stayscope.session import local_session
names = e.queries()
assert "r2_department_analysis" in names and not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
spark = local_session("2", partitions=2)
assert names["r2_department_analysis"](spark, "/root/testdata/sf0.001").count() > 0
spark.stop()
print("works")
"""


@pytest.mark.parametrize("leave_pipeline", [True, False])
def test_entry_points_without_the_training_data_part(tmp_path, leave_pipeline):
    copy = tmp_path / "copy"
    gone = {"llm", ".git", "__pycache__"} | (set() if leave_pipeline else {"corpus_pipeline.py"})
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in gone])
    assert (copy / "corpus_pipeline.py").exists() == (leave_pipeline and (ROOT / "corpus_pipeline.py").exists())
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=300, env=None)
    assert ran.stdout.strip().endswith("works"), ran.stderr[-2000:]
