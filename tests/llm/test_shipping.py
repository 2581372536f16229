"""Python workers find the package without any search path set for them."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from plumbline.llm import neighbours, pii
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "mail a@b.example.com"), (2, None)], "doc_id long, text string")
assert sorted((r.doc_id, r.n_email) for r in pii.find(docs).collect()) == [(1, 1), (2, 0)]
vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
assert [r.vec_id for r in neighbours.nearest(vectors).collect()] == [1]
"""


def test_workers_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", CODE, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
