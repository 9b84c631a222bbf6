"""Policy lookup: purpose and field type give keep, partial or redact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import mask_spec, masked
from veilspark.sources.tables import few


def apply_policy(labelled: DataFrame, rules: DataFrame) -> DataFrame:
    """Every fragment under every purpose: adds purpose, outcome, critical, mask.

    A left join that fails closed: no label, an unknown type or a type that the
    purpose does not name is redacted, and so is a partial value that cannot be
    masked. The purposes are a column, so one job serves all; rules are a table of
    a few rows for each purpose and are broadcast once their size is known."""
    rules = few(rules)
    fanned = labelled.crossJoin(few(rules.select("purpose").distinct()))
    known = few(rules.withColumn("_spec", mask_spec(F.col("reveal"), F.col("format"))).withColumnsRenamed({"purpose": "_p", "ftype": "_t", "outcome": "_o", "critical": "_c"}))
    joined = fanned.join(known, (F.col("purpose") == F.col("_p")) & (F.col("ftype") == F.col("_t")), "left")
    mask = F.when(F.col("_o") == "partial", masked(F.col("text"), F.col("_spec"), F.col("format")))
    outcome = F.when((F.col("_o") == "partial") & F.col("_mask").isNull(), "redact").otherwise(F.coalesce("_o", F.lit("redact")))
    return joined.withColumn("_mask", mask).select(*labelled.columns, "purpose", outcome.alias("outcome"), F.coalesce("_c", F.lit(False)).alias("critical"), F.col("_mask").alias("mask"), ((F.col("_o") == "partial") & F.col("_mask").isNull()).alias("unmaskable"))
