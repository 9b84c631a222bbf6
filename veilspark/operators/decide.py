"""Decisions: one outcome for each fragment, tightened by nets and audits.

Precedence among conflicting claims is redact, partial, keep; a fragment without a
claim is redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import matches
from veilspark.sources.tables import few
from veilspark.schema import REPAIR_AMOUNT, REPAIR_NAME


def reconcile(frags: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, purpose, frag_id, outcome, unfilled) of every fragment under every purpose
    that has claims (doc_id, purpose, frag_id, outcome). Claims on fragments that the
    document does not have are dropped."""
    rank = F.min(F.when(F.col("outcome") == "redact", 0).when(F.col("outcome") == "partial", 1).when(F.col("outcome") == "keep", 2)).alias("rank")
    best = claims.groupBy(F.col("doc_id").alias("_d"), F.col("purpose").alias("_p"), F.col("frag_id").alias("_f")).agg(rank)
    wanted = claims.select(F.col("doc_id").alias("_wd"), "purpose").distinct()
    every = frags.select("doc_id", "frag_id").join(wanted, F.col("doc_id") == F.col("_wd")).drop("_wd")
    joined = every.join(best, (F.col("doc_id") == F.col("_d")) & (F.col("purpose") == F.col("_p")) & (F.col("frag_id") == F.col("_f")), "left")
    outcome = F.when(F.col("rank") == 1, "partial").when(F.col("rank") == 2, "keep").otherwise("redact")
    return joined.select("doc_id", "purpose", "frag_id", outcome.alias("outcome"), F.col("rank").isNull().alias("unfilled"))


def apply_nets(decided: DataFrame) -> DataFrame:
    """Adds pattern and matched_text of the net that overrides an outcome, and redacts.

    decided carries net_one and net_two (see nets.with_nets). The pattern net leaves
    partial fragments alone, the context net does not; neither looks at what is
    redacted already."""
    hit = F.when(F.col("outcome") == "keep", F.coalesce("net_one", "net_two")).when(F.col("outcome") == "partial", F.col("net_two"))
    marked = decided.withColumn("_hit", hit)
    return marked.select(*[c for c in decided.columns if c != "outcome"], F.when(F.col("_hit").isNotNull(), "redact").otherwise(F.col("outcome")).alias("outcome"), F.col("_hit.pattern").alias("pattern"), F.col("_hit.matched_text").alias("matched_text"))


def audit_guardrail(decided: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, purpose, frag_id, ordinal, blocked) of the flags that count: the first on
    each visible fragment, blocked where the purpose's critical types protect it.

    decided needs outcome and critical; flags: doc_id, purpose, ordinal, frag_id."""
    first = flags.groupBy(F.col("doc_id").alias("_d"), F.col("purpose").alias("_p"), F.col("frag_id").alias("_f")).agg(F.min("ordinal").alias("ordinal"))
    seen = decided.where("outcome = 'keep'").join(first, (F.col("doc_id") == F.col("_d")) & (F.col("purpose") == F.col("_p")) & (F.col("frag_id") == F.col("_f")))
    return seen.select("doc_id", "purpose", "frag_id", "ordinal", F.col("critical").alias("blocked"))


def apply_audit(decided: DataFrame, flags: DataFrame) -> DataFrame:
    """Redacts what the guardrail lets an audit flag: adds audited."""
    acted = audit_guardrail(decided, flags).where("NOT blocked").select(F.col("doc_id").alias("_d"), F.col("purpose").alias("_p"), F.col("frag_id").alias("_f"))
    joined = decided.join(acted, (F.col("doc_id") == F.col("_d")) & (F.col("purpose") == F.col("_p")) & (F.col("frag_id") == F.col("_f")), "left")
    return joined.select(*[c for c in decided.columns if c != "outcome"], F.when(F.col("_f").isNotNull(), "redact").otherwise(F.col("outcome")).alias("outcome"), F.col("_f").isNotNull().alias("audited"))


def repair(decided: DataFrame) -> DataFrame:
    """Re-keeps amounts on salary rows and name words on holder rows under
    proof_of_income: adds repaired. Never what a net hits, and never on a row that
    names a relative. decided carries the rows' evidence and the nets' columns."""
    amount = F.col("row_salary") & matches(F.col("text"), REPAIR_AMOUNT)
    named = F.col("row_holder") & F.col("text").rlike(REPAIR_NAME) & (F.length("text") > 1)
    worth = ~F.col("row_third_party") & (amount | named) & F.col("net_one").isNull() & F.col("net_two").isNull()
    fixed = worth & (F.col("purpose") == "proof_of_income") & (F.col("outcome") == "redact")
    return decided.withColumn("_fixed", fixed).select(*[c for c in decided.columns if c != "outcome"], F.when(F.col("_fixed"), "keep").otherwise(F.col("outcome")).alias("outcome"), F.col("_fixed").alias("repaired"))


def fail_closed(frags: DataFrame, purposes: DataFrame) -> DataFrame:
    """Everything redacted, for documents whose labels cannot be had."""
    return frags.select("doc_id", "frag_id").crossJoin(few(purposes.select("purpose").distinct())).withColumn("outcome", F.lit("redact"))


def results(decided: DataFrame) -> DataFrame:
    """One row for each document and purpose: id lists, masks, what the nets and the audit
    hit and why, and warnings for a reader.

    warnings tells of unlabelled fragments, masks and values that could not be masked,
    nets, audits and repairs, each with its count; it is empty for a plain run."""
    ids = lambda o: F.array_sort(F.collect_list(F.when(o, F.col("frag_id"))))
    is_ = lambda o: F.col("outcome") == o
    none = F.lit(None).cast("boolean")
    flag = lambda name: F.coalesce(F.col(name) if name in decided.columns else none, F.lit(False))
    hit = F.when(F.col("pattern").isNotNull(), F.struct("frag_id", "pattern", "matched_text")).when(flag("audited"), F.struct("frag_id", F.lit("audit").alias("pattern"), F.lit(None).cast("string").alias("matched_text")))
    masks = F.map_from_entries(F.collect_list(F.when(is_("partial"), F.struct("frag_id", "mask"))))
    unlabelled = F.col("ftype").isNull()
    counts = {
        "without a label: redacted": unlabelled, "shown by a mask": is_("partial"), "that could not be masked: redacted": flag("unmaskable"), "hidden by a net for personal data": F.col("pattern").isNotNull(),
        "hidden by the audit": flag("audited"), "given back by the repair": flag("repaired"),
    }
    grouped = decided.groupBy("doc_id", "purpose").agg(
        ids(is_("keep")).alias("visible_ids"), ids(is_("partial")).alias("partial_ids"), ids(is_("redact")).alias("redact_ids"), masks.alias("partial_masks"), ids(unlabelled).alias("unlabelled_ids"),
        F.array_sort(F.collect_list(hit)).alias("hits"), *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(counts.values())],
    )
    warnings = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.concat(F.col(f"_n{i}").cast("string"), F.lit(f" fragment(s) {text}"))) for i, text in enumerate(counts)]))
    return grouped.withColumn("warnings", warnings).drop(*[f"_n{i}" for i in range(len(counts))])


def summary(decided: DataFrame) -> DataFrame:
    """(doc_id, purpose, fragments, visible, masked, redacted)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return decided.groupBy("doc_id", "purpose").agg(F.count("*").alias("fragments"), n("keep").alias("visible"), n("partial").alias("masked"), n("redact").alias("redacted"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the given order; which row stays is defined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
