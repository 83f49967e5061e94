"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where none is set, only a session whose executors run inside this process gets a folder of its
    own; on a cluster a machine-local folder would lose rows, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hydrosheaf-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage ends here, sizes are known.

    Several branches of a plan then read one table instead of deriving it again each, and the planner
    can tell that a small table is small.  The file system deletes the table when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


_NARROW = ("Project", "Filter", "SubqueryAlias")


def is_scan(df: DataFrame) -> bool:
    """Whether the table is read from files and at most projected or filtered, so reading it twice is cheap."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in _NARROW:
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def held(df: DataFrame) -> DataFrame:
    """The table for use in several branches: itself where it is a scan, else staged."""
    return df if is_scan(df) else staged(df)
