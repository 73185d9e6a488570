"""What operators leave behind."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{where}").getOrCreate()
from marginalia.llm import common
df = spark.range(10).selectExpr("id", "id % 2 AS g")
assert common.numbered(common.table(df, "x"), "g", ["id"], "n").count() == 10
import os
assert os.listdir("{where}")
spark.stop()
"""


def test_no_folder_is_left_when_the_session_has_ended(tmp_path):
    where = tmp_path / "shared"
    where.mkdir()
    home = str(Path(__file__).resolve().parent.parent.parent)
    done = subprocess.run([sys.executable, "-c", CODE.format(where=where)], cwd=home, env=os.environ | {"PYTHONPATH": home}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(100):  # the JVM ends a moment after Python
        if not os.listdir(where):
            break
        import time

        time.sleep(0.2)
    assert os.listdir(where) == []
