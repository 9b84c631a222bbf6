"""Presets: what each purpose keeps, redacts and masks; as a table of rules."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.schema import FIELD_TYPES

SPEC = "struct<reveal:string,format:string>"
PRESET = f"struct<label:string,keep_types:array<string>,redact_types:array<string>,keep:array<string>,redact:array<string>,purpose_critical_types:array<string>,partial_types:map<string,{SPEC}>>"
BUILT_IN = Path(__file__).resolve().parent.parent / "presets.json"


def read_presets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(purpose, label, keep_types, redact_types, keep, redact, critical, partial_types)
    of a JSON file of presets; the built-in ones without a path."""
    if path:
        raw = spark.read.text(path, wholetext=True)
    else:
        raw = spark.createDataFrame([(BUILT_IN.read_text(encoding="utf-8"),)], "value string")
    parsed = raw.select(F.explode(F.from_json("value", f"map<string,{PRESET}>", {"mode": "FAILFAST"})).alias("purpose", "p"))
    return parsed.select("purpose", "p.label", "p.keep_types", "p.redact_types", "p.keep", "p.redact", F.col("p.purpose_critical_types").alias("critical"), "p.partial_types")


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def violations(presets: DataFrame) -> DataFrame:
    """(purpose, problem): what makes a preset unusable; empty for a good table."""
    specs = F.coalesce(F.map_entries("partial_types"), F.array().cast(f"array<struct<key:string,value:{SPEC}>>"))
    kept = F.array_union(F.coalesce("keep_types", "keep", F.array().cast("array<string>")), _strings("critical"))
    found = F.array_compact(
        F.concat(
            F.array(
                F.when(F.col("label").isNull(), F.lit("no label")),
                F.when(~((F.col("keep").isNotNull() & F.col("redact").isNotNull()) | (F.col("keep_types").isNotNull() & F.col("redact_types").isNotNull())), F.lit("no keep and redact types")),
            ),
            F.transform(specs, lambda e: F.when(e["value"].isNull() | e["value"]["reveal"].isNull() | e["value"]["format"].isNull(), F.concat(F.lit("no reveal and format: "), e["key"]))),
            F.transform(specs, lambda e: F.when(F.array_contains(kept, e["key"]), F.concat(F.lit("kept and masked: "), e["key"]))),
        )
    )
    return presets.select("purpose", F.explode(found).alias("problem"))


def checked(presets: DataFrame) -> DataFrame:
    """The presets; raises ValueError if any is unusable."""
    bad = violations(presets).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['purpose']}: {r['problem']}" for r in bad))
    return presets


def partial_specs(presets: DataFrame) -> DataFrame:
    """(purpose, ftype, reveal, format): names trimmed; blank names and empty specs dropped."""
    each = presets.select("purpose", F.explode("partial_types").alias("name", "spec"))
    return each.select("purpose", F.trim("name").alias("ftype"), "spec.reveal", "spec.format").where("ftype <> '' AND (reveal IS NOT NULL OR format IS NOT NULL)")


def policy_rules(presets: DataFrame) -> DataFrame:
    """(purpose, ftype, outcome, critical, reveal, format) of every type that a preset
    names: partial before keep, keep only if it isn't redacted too, else redact. What is
    not in this table is redacted."""
    named = presets.select("purpose", F.explode(F.array_distinct(F.concat(_strings("keep_types"), _strings("redact_types"), _strings("critical"), F.coalesce(F.map_keys("partial_types"), F.array().cast("array<string>"))))).alias("ftype"), _strings("keep_types").alias("k"), _strings("redact_types").alias("r"), _strings("critical").alias("c"))
    named = named.withColumn("ftype", F.trim("ftype")).where("ftype <> ''").distinct()
    specs = partial_specs(presets).withColumnsRenamed({"purpose": "_p", "ftype": "_t"})
    joined = named.join(specs, (F.col("purpose") == F.col("_p")) & (F.col("ftype") == F.col("_t")), "left")
    outcome = F.when(F.col("_t").isNotNull(), "partial").when(F.array_contains("k", F.col("ftype")) & ~F.array_contains("r", F.col("ftype")), "keep").otherwise("redact")
    return joined.select("purpose", "ftype", outcome.alias("outcome"), F.array_contains("c", F.col("ftype")).alias("critical"), "reveal", "format")


def policy_matrix(spark: SparkSession, rules: DataFrame) -> DataFrame:
    """Every purpose with every field type: the outcome, whether it is listed, critical."""
    types = spark.createDataFrame([(t,) for t in FIELD_TYPES], "ftype string")
    grid = rules.select("purpose").distinct().crossJoin(F.broadcast(types))  # purposes x 28 types
    known = rules.select(F.col("purpose").alias("_p"), F.col("ftype").alias("_t"), "outcome", "critical")
    joined = grid.join(known, (F.col("purpose") == F.col("_p")) & (F.col("ftype") == F.col("_t")), "left")
    return joined.select("purpose", "ftype", F.coalesce("outcome", F.lit("redact")).alias("outcome"), F.col("outcome").isNotNull().alias("listed"), F.coalesce("critical", F.lit(False)).alias("critical"))
