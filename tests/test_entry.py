"""The driver contract from a folder that is not the repository's."""

import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
import __spark_entry__ as contract
rows = contract.entry(spark).collect()
assert [r["file"] for r in rows] == ["0", "1", "2", "TOTAL"], rows
assert contract.queries()["w4_evaluation_rank"](spark, "/root/testdata/sf0.001").count() == 500
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Tasks run without the repository on the workers' path, and the set folder is used."""
    shared = tmp_path / "shared"
    code = SCRIPT.format(root=ROOT, shared=str(shared))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert any(shared.iterdir())
