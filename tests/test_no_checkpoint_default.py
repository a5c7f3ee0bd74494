"""Without spark.checkpoint.dir a session on one machine uses its warehouse; a cluster session gets a clear error."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.warehouse.dir", sys.argv[2]).config("spark.ui.showConsoleProgress", "false").getOrCreate())
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__ as e
q = e.queries()
print("ROWS", q["throttle_batch"](spark, "/root/testdata/sf0.001").count(),
      q["upsert_settings"](spark, "/root/testdata/sf0.001").count())
print("FOLDER", spark.sparkContext.getCheckpointDir())
"""


def test_a_local_session_uses_its_warehouse(tmp_path):
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path), PYTHONPATH=ROOT)  # an empty conf folder: no defaults
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "warehouse")], env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 645 75" in out.stdout, out.stderr[-2000:]
    assert str(tmp_path / "warehouse") in out.stdout.split("FOLDER")[1]


def test_a_cluster_session_must_name_a_shared_folder():
    from campusflow.session import checkpoint_dir
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                            sparkContext=SimpleNamespace(master="spark://head:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(spark)
