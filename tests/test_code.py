"""Python workers find the package's code wherever the driver starts."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from strandline.operators import repeats, search, suffixes
texts = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGT")], "id long, t string")
assert suffixes.suffix_array(texts, "t", "id").count() == 12
assert [tuple(r) for r in repeats.supermaximal_repeats(texts, "t", "id", 4).collect()] == [("ACGT", 3)]
assert search.find_approximate(texts, "t", "ACGT", 0, "id").count() == 3
"""


def test_workers_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-3000:]
