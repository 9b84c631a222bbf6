"""The whole plan: fragments and labels to one outcome for each fragment and purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.anchors import anchor_all, labelled
from veilspark.operators.decide import apply_audit, apply_nets, repair
from veilspark.operators.layout import laid_out
from veilspark.operators.nets import with_nets
from veilspark.operators.policy import apply_policy
from veilspark.sources.tables import materialized


def run_plan(frags: DataFrame, labels: DataFrame | None, rules: DataFrame, flags: DataFrame | None = None, audit_rounds: int = 2) -> DataFrame:
    """Decides every fragment of every document under every purpose of the rules.

    Layout, anchors (five rules in order), policy, nets, audits (if flags are given:
    doc_id, purpose, round, ordinal, frag_id), repair. Without labels the fragments
    carry theirs as ftype. The result has the fragments' columns and purpose, ftype,
    outcome (keep, partial, redact), mask, pattern, matched_text, audited and repaired.

    Fragments are dealt out by their centres for the layout and by their rows for the
    evidence. Two tables are written on the way, the laid-out fragments and the labelled
    ones: several steps read each, and neither depends on a purpose; what follows is
    expressions, broadcast joins and one join for the labels' values."""
    laid = materialized(laid_out(frags))
    wide = materialized(labelled(with_nets(laid), labels))
    decided = apply_nets(apply_policy(anchor_all(wide), rules))
    audited = F.lit(False)
    if flags is not None:
        for k in range(1, audit_rounds + 1):
            decided = apply_audit(decided, flags.where(F.col("round") == k)).withColumnRenamed("audited", f"_audited{k}")
            audited = audited | F.col(f"_audited{k}")
    decided = decided.withColumn("audited", audited).drop(*[f"_audited{k}" for k in range(1, audit_rounds + 1)])
    return repair(decided)
