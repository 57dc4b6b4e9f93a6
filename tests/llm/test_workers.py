"""Executors may lack this package: every query runs with workers that cannot import it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "{parts}").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {ck!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def found(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("quillspark") is not None] * b.num_rows)], ["x"])

assert not spark.range(4).mapInArrow(found, "x boolean").filter("x").count()
from quillspark.llm.queries import QUERIES
for name, query in QUERIES.items():
    assert query(spark, {sf!r}).count() > 0, name
for name in ("op6_toxicity", "op1_language_id"):
    rows = QUERIES[name](spark, {sf!r}).orderBy("doc_id").collect()
    print("ROWS", name, [tuple(r) for r in rows])
"""


def run(parts, ck, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.realpath(p) != ROOT]
    env["PYTHONPATH"] = ":".join(paths)
    script = SCRIPT.format(root=ROOT, parts=parts, ck=ck, sf=sf)
    done = subprocess.run([sys.executable, "-c", script], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return [line for line in done.stdout.splitlines() if line.startswith("ROWS")]


def test_workers_without_the_package(tmp_path):
    """And the fitted models are the same under another number of partitions."""
    sf = "/root/testdata/sf0.01"
    few, many = run(3, f"file://{tmp_path}/a", sf), run(17, f"file://{tmp_path}/b", sf)
    assert len(few) == 2 and few == many
