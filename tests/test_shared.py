"""Folders of intermediate tables in the shared folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
from pyspark.sql import SparkSession
from medialake.plans.shared import stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
kept = spark.range(3)
kept.write.parquet(sys.argv[1] + "/kept")
first = stored(spark.range(5))
second = stored(first.selectExpr("id + 1 AS id"))
import os
print("folders", sum(name.startswith("medialake-") for name in os.listdir(sys.argv[1])), "rows", second.count())
spark.stop()
"""


def test_stored_tables_go_when_the_driver_ends(tmp_path):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120, check=True)
    assert "folders 2 rows 5" in done.stdout
    assert sorted(name for name in os.listdir(tmp_path) if name.startswith(("medialake-", "kept"))) == ["kept"]
