import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from hydrosheaf.deploy import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.codegen.wholeStage", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Three posts, one with ties, one much longer than the others."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for post, n, ties in (("short", 12, False), ("tied", 60, True), ("long", 700, False)):
        v = rng.gamma(3.0, 20.0, n)
        v = np.round(v / 15) * 15 + 5 if ties else v
        parts.append(pd.DataFrame({"post": post, "t": np.arange(1900, 1900 + n), "value": v}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(3)
