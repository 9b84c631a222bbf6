"""The plan over a stream of documents.

A document arrives whole, in one row, so every micro-batch is a batch job of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.cache import labels_through
from veilspark.plans.pipeline import run_plan
from veilspark.sources.model import Labeler, rule_labels
from veilspark.sources.tables import materialized
from veilspark.sources.text import fragments


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id string, text string, ts timestamp", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def redact_stream(documents: DataFrame, rules: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, labeler: Labeler = rule_labels, lateness: str = "1 day", store: str | None = None) -> StreamingQuery:
    """Decides every document that arrives. sink gets the decided fragments of each
    micro-batch and its number.

    A document that is delivered again with the same content within `lateness` is dropped
    under a watermark, which bounds the state; a null text is a content of its own. With
    a store of labels (see operators.cache) the labeler sees each content once, however
    many documents have it and in whichever batch they come."""
    keyed = documents.withColumn("content_hash", F.coalesce(F.sha2("text", 256), F.lit("")))
    fresh = keyed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["doc_id", "content_hash"])

    def each(batch: DataFrame, number: int) -> None:
        frags = materialized(fragments(batch))
        labels = labeler(frags) if store is None else labels_through(frags, labeler, store)
        sink(run_plan(frags, labels, rules), number)

    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
