"""Deterministic relabelling: row evidence corrects a labeler's field types.

The rules run in a fixed order, each on what the one before it has left:
value labels, amounts, names, third parties, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import is_label_phrase, label_word
from veilspark.operators.layout import medians, near, overlaps, with_row_flags
from veilspark.schema import RETYPEABLE, VALUE_LABELS


def labelled(frags: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Fragments with their rows' evidence and label: ftype is null without a label.

    Without labels the fragments carry ftype themselves, and nothing is joined. Labels
    of unknown fragments are dropped. One row for each fragment: of several labels the
    first by `ordinal` counts, if the labels have that column, else the least."""
    wide = with_row_flags(frags)
    if labels is None:
        return wide
    order = F.struct("ordinal", "ftype") if "ordinal" in labels.columns else F.struct("ftype")
    first = labels.groupBy(F.col("doc_id").alias("_ld"), F.col("frag_id").alias("_lf")).agg(F.min(order)["ftype"].alias("ftype"))
    return wide.drop("ftype").join(first, (F.col("doc_id") == F.col("_ld")) & (F.col("frag_id") == F.col("_lf")), "left").drop("_ld", "_lf")


def _retype(wide: DataFrame, condition: Column, to: str | Column) -> DataFrame:
    return wide.withColumn("ftype", F.when(condition, to if isinstance(to, Column) else F.lit(to)).otherwise(F.col("ftype")))


def anchor_amounts(wide: DataFrame) -> DataFrame:
    """A salary amount outside a row with a salary anchor is another amount."""
    return _retype(wide, (F.col("ftype") == "salary_amount") & ~F.col("row_salary"), "other_amount")


def anchor_names(wide: DataFrame) -> DataFrame:
    """A name on a ledger row (money, and a date or a transfer word) is a counterparty."""
    return _retype(wide, (F.col("ftype") == "name") & F.col("row_money") & (F.col("row_dated") | F.col("row_hinted")), "other")


def anchor_third_parties(wide: DataFrame) -> DataFrame:
    """Names on a row that names a relative, or if it holds none, on the row after it."""
    is_name = F.coalesce(F.col("ftype") == "name", F.lit(False))
    own = is_name & F.col("row_third_party") & ~is_label_phrase(label_word(F.col("text")))
    rows = Window.partitionBy("doc_id").orderBy("row_no")  # both frames are of one order: one sort
    empty = F.when(F.col("row_third_party") & (F.sum(F.col("_own").cast("int")).over(rows.rangeBetween(0, 0)) == 0), 1)
    marked = wide.withColumn("_own", own).withColumn("_empty", empty).withColumn("_after", F.max("_empty").over(rows.rangeBetween(-1, -1)))
    hit = F.col("_own") | (is_name & F.col("_after").isNotNull())
    return _retype(marked, hit, "father_name").drop("_own", "_empty", "_after")


def anchor_dates(wide: DataFrame) -> DataFrame:
    """A birth date on a dated or transfer row without a birth anchor is a transaction's."""
    return _retype(wide, (F.col("ftype") == "date_of_birth") & ~F.col("row_dob") & (F.col("row_dated") | F.col("row_hinted")), "transaction_date")


def forced_values(wide: DataFrame) -> DataFrame:
    """(doc_id, frag_id, forced): values that a printed field label types.

    A label row's values are the fragments after its last label word; if there are
    none, those of one of the two rows below it that is near and overlaps it in x.
    Only label rows meet their neighbours, by equality of document and row."""
    rows = medians(wide).where("row_group IS NOT NULL").withColumn("grp", F.col("row_group"))
    titles = rows.select("doc_id", "row_no", "grp", "med", "row_centre", "row_x0", "row_x1").distinct().select(F.col("doc_id").alias("_d"), F.col("row_no").alias("title_no"), "grp", "med", F.col("row_centre").alias("tc"), F.col("row_x0").alias("tx0"), F.col("row_x1").alias("tx1"))
    titles = titles.withColumnRenamed("med", "title_med")
    near_rows = titles.withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("_r", F.col("title_no") + F.col("offset"))
    met = wide.select("doc_id", "row_no", "frag_id", "x", (F.col("y") + F.col("h") / 2).alias("c"), "seq", "text", "row_centre", "row_x0", "row_x1").join(near_rows, (F.col("doc_id") == F.col("_d")) & (F.col("row_no") == F.col("_r")))
    word = label_word(F.col("text"))
    inside = F.lit(False)
    for i, (anchors, _) in enumerate(VALUE_LABELS):
        letters = ["".join(ch for ch in a if "A" <= ch <= "Z") for a in anchors]
        part = F.lit(False)
        for a in letters:
            part = part | F.instr(F.lit(a), word).cast("boolean")
        inside = inside | ((F.col("grp") == i) & part)
    is_label = (word != "") & (is_label_phrase(word) | inside)
    one = Window.partitionBy("doc_id", "title_no", "row_no")
    ordered = met.withColumn("_i", F.row_number().over(one.orderBy("x", "c", "seq"))).withColumn("_last", F.max(F.when(is_label, F.col("_i"))).over(one))
    close = near(F.col("tc"), F.col("row_centre"), F.col("title_med"))
    values = ordered.withColumn("_value", F.col("_i") > F.coalesce("_last", F.lit(0))).withColumn("_close", close)
    values = values.withColumn("_fits", F.col("_value") & ((F.col("offset") == 0) | (close & overlaps(F.col("tx0"), F.col("tx1"), F.col("row_x0"), F.col("row_x1")))))
    title = Window.partitionBy("doc_id", "title_no")
    # A second row counts only if the first below is near; the walk stops at a distant one.
    reach = F.coalesce(F.min(F.when(F.col("offset") == 1, F.col("_close"))).over(title), F.lit(True))
    chosen = values.withColumn("_reach", reach).withColumn("_fits", F.col("_fits") & ((F.col("offset") < 2) | F.col("_reach")))
    chosen = chosen.withColumn("_best", F.min(F.when(F.col("_fits"), F.col("offset"))).over(title)).where("_fits AND offset = _best")
    kinds = F.element_at(F.array(*[F.lit(t) for _, t in VALUE_LABELS]), F.col("grp") + 1)
    return chosen.groupBy("doc_id", "frag_id").agg(F.min_by(kinds, "title_no").alias("forced"))


def anchor_values(wide: DataFrame) -> DataFrame:
    """A generic or identifier-like label on a labelled value becomes that field."""
    forced = forced_values(wide).select(F.col("doc_id").alias("_fd"), F.col("frag_id").alias("_ff"), "forced")
    joined = wide.join(forced, (F.col("doc_id") == F.col("_fd")) & (F.col("frag_id") == F.col("_ff")), "left")
    return _retype(joined, F.col("forced").isNotNull() & F.col("ftype").isin(*RETYPEABLE), F.col("forced")).drop("_fd", "_ff", "forced")


RULES = {"label_value": anchor_values, "amount": anchor_amounts, "name": anchor_names, "third_party": anchor_third_parties, "date": anchor_dates}


def anchor_all(wide: DataFrame) -> DataFrame:
    for rule in RULES.values():
        wide = wide.transform(rule)
    return wide


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, frag_id, old_type, new_type) of the fragments that a rule retyped."""
    old = before.select("doc_id", "frag_id", F.col("ftype").alias("old_type"))
    return old.join(after.select("doc_id", "frag_id", F.col("ftype").alias("new_type")), ["doc_id", "frag_id"]).where(~F.col("old_type").eqNullSafe(F.col("new_type")))
