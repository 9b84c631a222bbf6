"""Acceptance checks as queries: each returns what is wrong, beside what was looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import mask_value, pii_hits, strip
from veilspark.operators.nets import pii_ids
from veilspark.sources.tables import few


def visible_pii(decided: DataFrame, frags: DataFrame) -> DataFrame:
    """Fragments that a net hits but that are neither redacted nor masked."""
    hit = pii_ids(frags).select(F.col("doc_id").alias("_d"), F.col("frag_id").alias("_f"))
    return decided.where("outcome = 'keep'").join(hit, (F.col("doc_id") == F.col("_d")) & (F.col("frag_id") == F.col("_f")), "left_semi")


def shown_pii(decided: DataFrame) -> DataFrame:
    """(purpose, fragments, visible_pii) of decisions that carry net_two, in one pass: the
    patterns are tried again on what is shown, the context net's finds are looked up."""
    hit = (F.size(pii_hits(F.col("text"))) > 0) | F.col("net_two").isNotNull()
    return decided.groupBy("purpose").agg(F.count("*").alias("fragments"), F.count_if((F.col("outcome") == "keep") & hit).alias("visible_pii"))


def bad_masks(decided: DataFrame, rules: DataFrame) -> DataFrame:
    """Masked fragments whose mask no rule of the purpose gives, or that show more than the end of the value."""
    specs = rules.where("outcome = 'partial'").select(F.col("purpose").alias("_p"), F.col("reveal").alias("_rev"), F.col("format").alias("_fmt"))
    masked = decided.where("outcome = 'partial'")
    fits = (F.col("purpose") == F.col("_p")) & (F.col("mask") == mask_value(F.col("text"), F.col("_rev"), F.col("_fmt")))
    wrong = masked.join(few(specs), fits, "left_anti")
    shown = masked.where(~F.col("mask").endswith(F.right(strip(F.col("text")), F.lit(4))))
    return wrong.unionByName(shown).distinct()


def literal_matches(frags: DataFrame, cases: DataFrame) -> DataFrame:
    """(case columns, frag_id): fragments that contain a case's literal, whatever the capitals.

    cases: doc_id, purpose, literal, kind. Joined by document first; the substring test
    is what remains."""
    c = cases.select(F.col("doc_id").alias("_d"), "purpose", "literal", "kind")
    return frags.select("doc_id", "frag_id", "text").join(few(c), (F.col("doc_id") == F.col("_d")) & F.contains(F.lower("text"), F.lower("literal"))).drop("_d", "text")


def case_failures(frags: DataFrame, decided: DataFrame, cases: DataFrame) -> DataFrame:
    """(doc_id, purpose, literal, problem): hidden literals that stay visible, and
    literals that no fragment holds any more. A visible literal that is hidden is
    reported as a note, never as a failure."""
    found = literal_matches(frags, cases)
    outcomes = decided.select(F.col("doc_id").alias("_d"), F.col("purpose").alias("_p"), F.col("frag_id").alias("_f"), "outcome")
    met = found.join(outcomes, (F.col("doc_id") == F.col("_d")) & (F.col("purpose") == F.col("_p")) & (F.col("frag_id") == F.col("_f")))
    per = met.groupBy("doc_id", "purpose", "literal", "kind").agg(F.count_if(F.col("outcome") == "keep").alias("shown"), F.count("*").alias("n"))
    p = per.select(F.col("doc_id").alias("_d"), F.col("purpose").alias("_p"), F.col("literal").alias("_l"), F.col("kind").alias("_k"), "shown", "n")
    joined = cases.join(p, (F.col("doc_id") == F.col("_d")) & (F.col("purpose") == F.col("_p")) & (F.col("literal") == F.col("_l")) & (F.col("kind") == F.col("_k")), "left")
    problem = F.when(F.col("n").isNull(), "stale").when((F.col("kind") == "hidden") & (F.col("shown") > 0), "leak").when((F.col("kind") == "visible") & (F.col("shown") == 0), "note: hidden")
    return joined.select("doc_id", "purpose", "literal", problem.alias("problem")).where("problem IS NOT NULL")


def layer_timings(calls: DataFrame) -> DataFrame:
    return calls.groupBy("layer").agg(F.sum("total_s").alias("total_s"), F.count("*").alias("calls"))
