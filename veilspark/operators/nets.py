"""PII nets: patterns on single fragments, and birth dates near their label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import UNICODE, contains_any, pii_hits
from veilspark.operators.layout import centre, medians, near
from veilspark.schema import CONTEXT_DATE, DOB_ANCHORS


def pattern_hits(frags: DataFrame) -> DataFrame:
    """One row for each pattern that a fragment matches: adds rank, pattern, matched_text."""
    return frags.select("*", F.inline(pii_hits(F.col("text"))))


def single_words(anchors: tuple[str, ...]) -> tuple[str, ...]:
    """The anchors that no other anchor is part of. Where they hold no space, a line
    holds an anchor just if one of its fragments does."""
    least = tuple(a for a in anchors if not any(b != a and b in a for b in anchors))
    if any(" " in a for a in least):
        raise ValueError("an anchor of several words needs the text of the line")
    return least


def regions_of(frags: DataFrame) -> DataFrame:
    """(_d, _l, times): lines with a birth anchor and the near lines next to one, and how
    often. Only sums of lines are dealt out; no line's text is put together."""
    anchored = contains_any(F.upper("text"), single_words(DOB_ANCHORS))
    lines = medians(frags).groupBy("doc_id", "line_no").agg(F.avg(centre()).alias("centre"), F.max("med").alias("med"), F.bool_or(anchored).alias("anchored"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    near_to = lines.select("doc_id", "line_no", "anchored", "centre", "med", F.lag("centre").over(w).alias("up"), F.lead("centre").over(w).alias("down")).where("anchored")
    region = F.array_compact(F.array(F.col("line_no"), F.when(near(F.col("centre"), F.col("up"), F.col("med")), F.col("line_no") - 1), F.when(near(F.col("centre"), F.col("down"), F.col("med")), F.col("line_no") + 1)))
    return near_to.select(F.col("doc_id").alias("_d"), F.explode(region).alias("_l")).groupBy("_d", "_l").agg(F.count("*").alias("times"))


def date_in(text: Column) -> Column:
    """The first numeric date in a text, empty without one."""
    return F.regexp_extract(text, UNICODE + CONTEXT_DATE, 0)


def context_hits(frags: DataFrame) -> DataFrame:
    """Numeric dates on a line with a birth anchor, or on a near line next to one.

    frags needs line_no. A fragment in the regions of two such lines is hit twice."""
    dates = frags.withColumn("matched_text", date_in(F.col("text"))).where("matched_text <> ''")
    hit = dates.join(regions_of(frags), (F.col("doc_id") == F.col("_d")) & (F.col("line_no") == F.col("_l")))
    return hit.withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_d", "_l", "_t", "times").withColumn("pattern", F.lit("date_of_birth"))


def with_nets(frags: DataFrame) -> DataFrame:
    """Adds net_one, the first pattern that a fragment matches, and net_two, the birth
    date that the context net finds in it: structs of pattern and matched_text, or null.

    The first is an expression; only fragments with a date meet a table, of the few
    lines in the region of a birth anchor."""
    kind = "struct<pattern:string,matched_text:string>"
    one = F.get(pii_hits(F.col("text")), F.lit(0))
    read = frags.withColumn("net_one", F.when(one.isNotNull(), F.struct(one["pattern"].alias("pattern"), one["matched_text"].alias("matched_text"))))
    dated = read.withColumn("_date", date_in(F.col("text")))
    rest = dated.where("_date = ''").drop("_date").withColumn("net_two", F.lit(None).cast(kind))
    met = dated.where("_date <> ''").join(regions_of(frags), (F.col("doc_id") == F.col("_d")) & (F.col("line_no") == F.col("_l")), "left")
    two = F.when(F.col("_l").isNotNull(), F.struct(F.lit("date_of_birth").alias("pattern"), F.col("_date").alias("matched_text")))
    return rest.unionByName(met.withColumn("net_two", two).drop("_date", "_d", "_l", "times"))


def pii_ids(frags: DataFrame) -> DataFrame:
    """(doc_id, frag_id) of every fragment that either net hits."""
    return pattern_hits(frags).select("doc_id", "frag_id").union(context_hits(frags).select("doc_id", "frag_id")).distinct()
