"""Rows, lines and their texts, rebuilt from geometry.

Everything is partitioned by document; an order always ends in seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import contains_any, is_ledger_date, is_money
from veilspark.schema import DOB_ANCHORS, LINE_FLOOR, NAME_ANCHORS, NEAR_FLOOR, NEAR_RATIO, ROW_RATIO, SALARY_ANCHORS, THIRD_PARTY, TXN_HINTS, VALUE_LABELS


def centre() -> Column:
    return F.col("y") + F.col("h") / 2


def upper_median(values: Column) -> Column:
    """The upper of the two middle values of an array, null if it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def median_heights(frags: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, med): the upper median of the heights, from their distinct values and counts."""
    counts = frags.groupBy(*keys, "h").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("n").over(w.orderBy("h"))).withColumn("all", F.sum("n").over(w))
    return upto.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min("h").alias("med"))


def with_rows(frags: DataFrame, ratio: float = ROW_RATIO) -> DataFrame:
    """Adds row_no: a fragment begins a row if its centre is more than ratio times the
    larger height away from that of the fragment before it, in order of centres."""
    w = Window.partitionBy("doc_id").orderBy(centre(), "seq")
    away = F.abs(centre() - F.lag(centre()).over(w)) > F.greatest("h", F.lag("h").over(w)) * F.lit(float(ratio))
    return frags.withColumn("_new", F.coalesce(away, F.lit(False)).cast("int")).withColumn("row_no", F.sum("_new").over(w).cast("int")).drop("_new")


#: Numbers that the fold of a page holds apart before it puts them away.
FOLD_CHUNK = 256


def geometry(frags: DataFrame, keys: tuple[str, ...] = ("doc_id",), ratio: float = ROW_RATIO) -> DataFrame:
    """(keys, _c, _h, row_no, line_no, med): what the distinct centres and heights of a
    page tell of their fragments. `keys` tell one page from another.

    Rows as in with_rows: of a centre's fragments only the first and the last by seq
    meet a neighbour. Lines: a fragment joins the last line if its centre is within
    tolerance of the line's mean centre so far, else it begins one; those of one centre
    always share a line. So one fold in order of centres gives both, over centres and
    heights with their counts, not over fragments. Numbers are put away by FOLD_CHUNK,
    since appending copies what it appends to. med is the upper median of the heights."""
    groups = frags.groupBy(*keys, centre().alias("c"), "h").agg(F.count("*").alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    pages = groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "s0", "s1", "h", "n"))).alias("gs"), F.sum("n").alias("all"))
    heights = F.array_sort(F.transform("gs", lambda g: F.struct(g["h"].alias("h"), g["n"].alias("n"))))
    middle = F.aggregate(
        heights, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("med")),
        lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["med"].isNull() & (a["upto"] + x["n"] > F.floor(F.col("all") / 2)), x["h"].cast("int")).otherwise(a["med"]).alias("med")), lambda a: a["med"],
    )
    none, chunks = F.array().cast("array<struct<row:int,line:int>>"), F.array().cast("array<array<struct<row:int,line:int>>>")
    zero = lambda name, value, kind: F.lit(value).cast(kind).alias(name)
    start = F.struct(zero("s", 0, "double"), zero("n", 0, "long"), zero("line", -1, "int"), zero("row", 0, "int"), zero("c", None, "double"), zero("h", None, "int"), zero("last", None, "int"), none.alias("ks"), chunks.alias("done"))

    def step(a: Column, x: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(x["c"] - a["s"] / a["n"]) <= F.col("tolerance"))
        line = a["line"] + F.when(near, 0).otherwise(1)
        same = a["c"].eqNullSafe(x["c"])
        apart = ~same & a["c"].isNotNull() & (F.abs(x["c"] - a["c"]) > F.greatest(x["h"], a["h"]) * F.lit(float(ratio)))
        row = a["row"] + F.when(apart, 1).otherwise(0)
        later = ~same | (x["s1"] > a["last"])
        k, full = F.struct(row.alias("row"), line.alias("line")), F.size(a["ks"]) >= FOLD_CHUNK
        return F.struct(
            (F.when(near, a["s"]).otherwise(0.0) + x["c"] * x["n"]).alias("s"), (F.when(near, a["n"]).otherwise(0) + x["n"]).cast("long").alias("n"), line.alias("line"), row.alias("row"), x["c"].alias("c"),
            F.when(later, x["h"]).otherwise(a["h"]).cast("int").alias("h"), F.when(later, x["s1"]).otherwise(a["last"]).cast("int").alias("last"), F.when(full, F.array(k)).otherwise(F.array_append(a["ks"], k)).alias("ks"), F.when(full, F.array_append(a["done"], a["ks"])).otherwise(a["done"]).alias("done"),
        )

    numbers = F.aggregate("gs", start, step, lambda a: F.flatten(F.array_append(a["done"], a["ks"])))
    known = pages.withColumn("med", middle).withColumn("tolerance", F.greatest(F.col("med") / 2, F.lit(float(LINE_FLOOR)))).withColumn("ks", numbers)
    each = F.transform(F.arrays_zip(F.col("gs").alias("g"), F.col("ks").alias("k")), lambda z: F.struct(z["g"]["c"].alias("_c"), z["g"]["h"].alias("_h"), z["k"]["row"].alias("row_no"), z["k"]["line"].alias("line_no"), F.col("med").alias("med")))
    return known.select(*keys, F.inline(each))


def laid_out(frags: DataFrame) -> DataFrame:
    """Adds row_no, line_no and med, the document's median height, by one join."""
    same = (F.col("doc_id") == F.col("_d")) & (centre() == F.col("_c")) & (F.col("h") == F.col("_h"))
    return frags.join(geometry(frags).withColumnRenamed("doc_id", "_d"), same).drop("_d", "_c", "_h")


def with_lines(frags: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds line_no and med of these fragments' pages (see geometry)."""
    own = frags.drop("med").withColumn("_c", centre()).withColumn("_h", F.col("h"))
    return own.join(geometry(frags, keys).drop("row_no"), [*keys, "_c", "_h"]).drop("_c", "_h")


def medians(frags: DataFrame) -> DataFrame:
    """The fragments with med; their own column, if they have it."""
    return frags if "med" in frags.columns else frags.join(median_heights(frags), "doc_id")


def joined_text(no: str) -> Column:
    """The texts of a row or line in order of x; aggregate over groups of (doc_id, no)."""
    parts = F.array_sort(F.collect_list(F.struct("x", centre().alias("c"), "seq", "text")))
    return F.array_join(F.transform(parts, lambda t: t["text"]), " ")


def row_texts(frags: DataFrame, no: str = "row_no") -> DataFrame:
    """(doc_id, no, text, centre, x0, x1, n) of each row or line."""
    return frags.groupBy("doc_id", no).agg(joined_text(no).alias("text"), F.avg(centre()).alias("centre"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.count("*").alias("n"))


def row_flags(frags: DataFrame) -> DataFrame:
    """(doc_id, row_no, ...): what the rules ask of each row."""
    return _flagged(frags).drop("_fs")


def with_row_flags(frags: DataFrame) -> DataFrame:
    """Fragments with what the rules ask of their rows. Rows are gathered once, with
    their fragments, and laid out again: no join. The row's text stays behind."""
    flagged = _flagged(frags).drop("row_text")
    return flagged.select("doc_id", "row_no", F.inline("_fs"), *[c for c in flagged.columns if c.startswith("row_") and c != "row_no"])


def _flagged(frags: DataFrame) -> DataFrame:
    own = [c for c in frags.columns if c not in ("doc_id", "row_no")]
    base = frags.groupBy("doc_id", "row_no").agg(F.collect_list(F.struct(*own)).alias("_fs"), F.avg(centre()).alias("row_centre"), F.min("x").alias("row_x0"), F.max(F.col("x") + F.col("w")).alias("row_x1"), F.bool_or(is_money(F.col("text"))).alias("row_money"), F.bool_or(is_ledger_date(F.col("text"))).alias("row_dated"))
    in_order = F.array_sort(F.transform("_fs", lambda f: F.struct(f["x"], f["y"] + f["h"] / 2, f["seq"], f["text"].alias("text"))))
    t = F.col("row_text")
    return base.withColumn("row_text", F.upper(F.array_join(F.transform(in_order, lambda f: f["text"]), " "))).select(
        "*", contains_any(t, TXN_HINTS).alias("row_hinted"), contains_any(t, SALARY_ANCHORS).alias("row_salary"), contains_any(t, NAME_ANCHORS).alias("row_holder"), contains_any(t, THIRD_PARTY).alias("row_third_party"), contains_any(t, DOB_ANCHORS).alias("row_dob"), label_groups(t).alias("row_group")
    )


def label_groups(text: Column) -> Column:
    """The number of the first value-label group that a row's text holds, else null."""
    group = F.lit(None).cast("int")
    for i, (anchors, _) in reversed(list(enumerate(VALUE_LABELS))):
        group = F.when(contains_any(text, anchors), i).otherwise(group)
    return group


def near(a: Column, b: Column, med: Column) -> Column:
    """Whether two rows or lines with these mean centres are close enough to be one region."""
    return F.abs(a - b) <= F.greatest(med * NEAR_RATIO, F.lit(float(NEAR_FLOOR)))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (b0 < a1) & (a0 < b1)


def row_of(frags: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fragments of the rows that hold the wanted (doc_id, frag_id)."""
    own = frags.join(wanted.select("doc_id", "frag_id").distinct(), ["doc_id", "frag_id"]).select("doc_id", "row_no", F.col("frag_id").alias("wanted_id"))
    return frags.join(own, ["doc_id", "row_no"])
