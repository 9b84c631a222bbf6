"""Parsing of model replies: label lines, JSON, audits and document classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import MOST_IDS, match_type, short_id, strip
from veilspark.schema import AUDIT_LINE, BATCH, DOCUMENT_TYPES, LABEL_LINE, NO_FLAG_WORDS


def short_ids(frags: DataFrame, batch_size: int = BATCH) -> DataFrame:
    """Adds batch and short_id: fragments in order of seq are cut into batches of at most
    MOST_IDS; inside a batch they are named a00, a01, …"""
    if not 0 < batch_size <= MOST_IDS:
        raise ValueError(f"a batch has 1 to {MOST_IDS} fragments: there are no more short ids")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("seq")
    numbered = frags.withColumn("_n", F.row_number().over(w) - 1)
    return numbered.withColumn("batch", F.floor(F.col("_n") / batch_size).cast("int")).withColumn("short_id", short_id(F.col("_n") % batch_size)).drop("_n")


def label_lines(replies: DataFrame) -> DataFrame:
    """(doc_id, batch, line, short_id, token) of every line of the form `id: type`."""
    lines = replies.select("doc_id", "batch", F.posexplode(F.split("raw", "\r?\n")).alias("line", "text"))
    return lines.select("doc_id", "batch", "line", F.lower(F.regexp_extract("text", LABEL_LINE, 1)).alias("short_id"), F.regexp_extract("text", LABEL_LINE, 2).alias("token")).where("short_id <> ''")


def json_labels(replies: DataFrame) -> DataFrame:
    """The same of replies that are JSON: {"labels": [...]} or a list of {"id", "type"}."""
    item = "array<struct<id:string,type:string>>"
    body = F.regexp_replace(strip(F.col("raw")), "^`+|`+$", "")
    found = F.coalesce(F.from_json(body, f"struct<labels:{item}>")["labels"], F.from_json(body, item))
    rows = replies.where(strip(body).rlike(r"^[\[{]")).select("doc_id", "batch", F.posexplode(found).alias("line", "e"))
    return rows.select("doc_id", "batch", "line", F.lower(strip(F.col("e.id"))).alias("short_id"), F.coalesce("e.type", F.lit("")).alias("token")).where("short_id IS NOT NULL")


def parse_labels(replies: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, batch, frag_id, ftype, line): JSON where a reply is JSON, else lines.

    ids: (doc_id, batch, short_id, frag_id). Unknown ids and repeats are dropped (the
    first counts), an unknown type is `other`. A reply in lines whose types are all
    unknown gives nothing: see failed_replies()."""
    return _parsed(replies, ids).where("NOT failed").drop("failed")


def failed_replies(replies: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, batch) of replies in which no type could be recognised."""
    return _parsed(replies, ids).where("failed").select("doc_id", "batch").distinct()


def _parsed(replies: DataFrame, ids: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    as_json = json_labels(replies).withColumn("json", F.lit(True))
    as_lines = label_lines(replies).join(as_json.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_anti").withColumn("json", F.lit(False))
    known = as_json.unionByName(as_lines).join(ids.select("doc_id", "batch", "short_id", "frag_id"), ["doc_id", "batch", "short_id"])
    w = Window.partitionBy("doc_id", "batch", "frag_id").orderBy("line")
    first = known.withColumn("_k", F.row_number().over(w)).where("_k = 1").withColumn("_type", match_type(F.col("token")))
    reply = Window.partitionBy("doc_id", "batch")
    failed = ~F.col("json") & (F.count("_type").over(reply) == 0)
    return first.withColumn("failed", failed).select("doc_id", "batch", "frag_id", F.coalesce("_type", F.lit("other")).alias("ftype"), "line", "failed")


def parse_audits(replies: DataFrame) -> DataFrame:
    """(doc_id, batch, flagged, reason, ok): ids after FLAGGED, the first REASON; ok is
    false without a FLAGGED line, unless the reply is JSON with flagged_ids."""
    no_flag = F.array(*[F.lit(x) for x in NO_FLAG_WORDS])
    lines = F.split("raw", "\r?\n")
    parts = F.transform(lines, lambda t: F.struct(F.regexp_extract(t, AUDIT_LINE, 1).alias("k"), F.regexp_replace(strip(F.regexp_extract(t, AUDIT_LINE, 2)), "^[`*_\"']+|[`*_\"']+$", "").alias("v")))
    flags = F.filter(parts, lambda p: p["k"] == "FLAGGED")
    tokens = F.flatten(F.transform(F.filter(flags, lambda p: ~F.array_contains(no_flag, F.lower(p["v"]))), lambda p: F.split(p["v"], r"[,\s]+")))
    tidy = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "^[\\[\\]\"'`.]+|[\\[\\]\"'`.]+$", "")))
    reason = F.get(F.filter(parts, lambda p: (p["k"] == "REASON") & (p["v"] != "")), F.lit(0))["v"]
    body = F.from_json(F.regexp_replace(strip(F.col("raw")), "^`+|`+$", ""), "struct<flagged_ids:array<string>,reasoning:string>")
    from_json = F.transform(body["flagged_ids"], lambda x: F.lower(strip(x)))
    lined = F.size(flags) > 0
    flagged = F.when(lined, F.filter(tidy, lambda t: (t != "") & ~F.array_contains(no_flag, t))).otherwise(F.coalesce(from_json, F.array().cast("array<string>")))
    return replies.select("doc_id", "batch", flagged.alias("flagged"), F.coalesce(F.when(lined, reason).otherwise(strip(body["reasoning"])), F.lit("")).alias("reason"), (lined | from_json.isNotNull()).alias("ok"))


def document_type(answer: Column) -> Column:
    """The first known document type that an answer contains, else other."""
    found = F.lit("other")
    for name in reversed(DOCUMENT_TYPES):
        found = F.when(F.lower(answer).contains(name), name).otherwise(found)
    return found
