"""A persisted table of detected labels, keyed by the content of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.sources.tables import materialized

STORE = "key string, frag_id string, ftype string, inserted_at timestamp"


def content_keys(frags: DataFrame) -> DataFrame:
    """(doc_id, key): extent and sha256 of a document's fragments in order of seq."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(",", "x", "y", "w", "h", "text").alias("t"))))
    digest = F.sha2(F.array_join(F.transform(parts, lambda p: p["t"]), "\n"), 256)
    return frags.groupBy("doc_id").agg(F.concat(F.max(F.col("x") + F.col("w")).cast("string"), F.lit("x"), F.max(F.col("y") + F.col("h")).cast("string"), F.lit(":"), digest).alias("key"))


def image_key(width, height, content):  # noqa: ANN001, ANN201
    """The key of an image: its size and the sha256 of its bytes."""
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":"), F.sha2(content, 256))


def misses(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys that are not in the table yet, each once."""
    return keys.join(cached.select("key"), "key", "left_anti")


def hits(keys: DataFrame, cached: DataFrame) -> DataFrame:
    return keys.join(cached, "key")


def retained(cached: DataFrame, most: int | None = None) -> DataFrame:
    """The table after eviction: all rows, or the `most` last inserted keys. Only
    successful results belong in the table, so failures are tried again."""
    if most is None:
        return cached
    keys = cached.groupBy("key").agg(F.max("inserted_at").alias("_at")).orderBy(F.col("_at").desc(), "key").limit(most)
    return cached.join(F.broadcast(keys.select("key")), "key", "left_semi")


def latest(cached: DataFrame) -> DataFrame:
    w = Window.partitionBy("key", "frag_id").orderBy(F.col("inserted_at").desc())
    return cached.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored labels, the last of each fragment; empty where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return latest(spark.read.schema(STORE).parquet(path)) if there else spark.createDataFrame([], STORE)


def clear_store(spark: SparkSession, path: str) -> None:
    """Forget all stored labels."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def labels_through(frags: DataFrame, labeler: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Labels (doc_id, frag_id, ftype) of all fragments, each content labelled once: known
    contents from the store, new ones by the labeler, for one document of each content,
    and then stored. Contents without any label are not stored, so they are tried again."""
    spark = frags.sparkSession
    keys = materialized(content_keys(frags))
    known = read_store(spark, path)
    new = misses(keys, known.select("key").distinct()).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    new = materialized(new)
    own = frags.join(new.select("doc_id"), "doc_id", "left_semi")
    fresh = labeler(own).join(new, "doc_id").select("key", "frag_id", "ftype", F.current_timestamp().alias("inserted_at"))
    materialized(fresh).write.mode("append").parquet(path)
    return hits(keys, read_store(spark, path).drop("inserted_at")).select("doc_id", "frag_id", "ftype")
