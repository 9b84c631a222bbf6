"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def unused(name: str, *taken: str) -> str:
    """A column name like `name` that is none of `taken`, whatever the capitals."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again.

    A lost executor then costs a reread of a file, never a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("veilspark-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor (null ids: remainder of '')."""
    return F.crc32(F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))) % F.lit(divisor)


def bucket_of(key: Column, buckets: int) -> Column:
    """Equal ranges of a signed 64-bit key, numbered in the order of the key."""
    return F.shiftright(key, 64 - (buckets.bit_length() - 1)) + F.lit(buckets // 2)


def prefix_sums(df: DataFrame, parts: list[str], key: str, ties: list[str], weight: str, out: str, buckets: int = 4096) -> DataFrame:
    """Exclusive running sum of `weight` within `parts`, in the order of the
    uniformly distributed 64-bit `key` (ties broken by `ties`).

    Three levels, so that no task ever holds a whole part however hot it is: rows
    fall into equal ranges of the key, and ranges into about as many bundles as a bundle
    has ranges. The totals of a part's bundles are summed in order, then those of the
    ranges in each bundle; rows are ranked inside their own range only."""
    own = lambda prefix: [F.col(p).alias(f"{prefix}{i}") for i, p in enumerate(parts)]

    def same(prefix: str, level: str) -> Column:
        found = F.col(level) == F.col(f"{prefix}{level}")
        for i, p in enumerate(parts):
            found = found & F.col(p).eqNullSafe(F.col(f"{prefix}{i}"))
        return found

    ranged = df.withColumn("_range", bucket_of(F.col(key), buckets))
    bundle = F.shiftright("_range", (buckets.bit_length() - 1) // 2).alias("_bundle")
    totals = ranged.groupBy(*parts, "_range").agg(F.sum(weight).alias("_total")).select("*", bundle)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bundles = totals.groupBy(*parts, "_bundle").agg(F.sum("_total").alias("_total"))
    firsts = bundles.select(*own("_q"), F.col("_bundle").alias("_q_bundle"), F.coalesce(F.sum("_total").over(before(Window.partitionBy(*parts).orderBy("_bundle"))), F.lit(0)).alias("_first"))
    summed = totals.withColumn("_more", F.coalesce(F.sum("_total").over(before(Window.partitionBy(*parts, "_bundle").orderBy("_range"))), F.lit(0)))
    starts = summed.join(firsts, same("_q", "_bundle")).select(*own("_p"), F.col("_range").alias("_p_range"), (F.col("_first") + F.col("_more")).alias("_start"))
    inside = Window.partitionBy(*parts, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    dealt = ranged.repartition(*parts, "_range")  # else Spark may keep an earlier dealing by the parts alone
    ranked = dealt.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = ranked.join(starts, same("_p", "_range"))
    return joined.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(out))
