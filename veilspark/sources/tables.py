"""Tables on shared storage: reading the driver's tables, writing intermediate ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table of rules or cases that may be broadcast: some hundred bytes each.
FEW = 50_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df as a literal table for broadcast, if it has at most `most` rows; else as it is,
    for Spark to choose. At most that many rows come to the driver."""
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session or
    of its context. Where neither is set, a temporary folder serves one machine; on a
    cluster that is an error, since each executor would write to a disk of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, folder, True)
        where = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again, so that a rerun task never
    asks a service twice. The files stay: whoever owns the folder removes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
