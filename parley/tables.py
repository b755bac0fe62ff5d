"""Tables in the shared folder: what a plan reads more than once is written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder below the one that driver and executors share, which spark.checkpoint.dir names.

    Where that is unset a local session takes a temporary folder; a cluster has none that all machines see, so it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="parley-shared-")
            sc.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder.rstrip('/')}/parley-{sc.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, runs the plan one time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._parley_path = path
    return table


def drop(*tables: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote, once nothing reads it any more."""
    for table in tables:
        if table is not None:
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._parley_path)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
