"""Queries on executors that have the libraries, but not this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})  # of this process, not of its workers
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
try:
    spark.range(1).rdd.map(lambda _: __import__("lamina")).collect()
except Exception as e:
    assert "No module named 'lamina'" in str(e)
else:
    raise AssertionError("workers find the package")
for name in sys.argv[1:]:
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("done", name)
"""
QUERIES = (
    "op1_simhash_vptree", "op2_line_blocks", "op3_quality_ordinal", "op4_poisson_mix", "op5_block_ann", "op6_suffix_dedup", "op7_chat_spans", "op8_url_words",
    "op9_compression_toxicity", "op10_wu_manber", "op11_heavy_light_join", "op12_annular_codes", "op13_tandem_runs", "pipeline", "gcn_1layer", "traced_gat", "rgcn_2layer", "edge_budget_batches",
)


@pytest.mark.parametrize("at", range(2))
def test_workers_need_no_copy_of_the_package(tmp_path, at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT)
    names = QUERIES[at::2]
    done = subprocess.run([sys.executable, "run.py", *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.split() == [w for n in names for w in ("done", n)], done.stderr[-3000:]
