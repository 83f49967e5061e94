"""Queries run where the workers cannot find the package by their folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from hydrosheaf.deploy import ship
from hydrosheaf.operators import fits
ship(s)
d = s.createDataFrame([("a", k, float(k * k + 1)) for k in range(12)], "post string, t bigint, value double")
assert fits.simple_fits(d).first()["shape"] > 0
print("fine")
"""


def test_foreign_working_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0 and "fine" in got.stdout, got.stderr[-2000:]


def test_cluster_without_shared_folder():
    import pytest

    from hydrosheaf.plans import store

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        store.shared_folder(Session())
