"""The entry from a working directory where executors cannot find the packages by themselves."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

from workload import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__
print("rows", __spark_entry__.entry(spark).count())
"""


def test_entry_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=str(ROOT))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert out.stdout.split()[-2:] == ["rows", "10"], out.stderr[-2000:]


LISTING = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op')])"


def _listed(folder, code=LISTING):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_subpackage(tmp_path):
    left_out = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json", "*.txt")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=left_out)
    out = _listed(tmp_path / "rest")
    assert out.returncode == 0, out.stderr[-2000:]
    queries, oracles, ops = out.stdout.split(" ", 2)
    assert int(queries) == len(QUERIES) and int(oracles) == len(ORACLES) and ops.strip() == "[]"


def test_entry_without_a_package_of_the_subpackage():
    out = _listed(ROOT, "import sys; sys.modules['xxhash'] = None; " + LISTING)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[0]) == len(QUERIES)
