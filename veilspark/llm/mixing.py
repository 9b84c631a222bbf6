"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import WORD, bucket_of, table, written

#: Fixed by the mix: weights of the sources in their order, repeating; the share of
#: all sizes that is taken; how often a source may be repeated.
WEIGHTS, SHARE, MOST_EPOCHS = (3, 1, 2), 1.5, 2
#: Ranges of the hash key within a source.
RANGES = 4096
#: A plan of at most this many sources is broadcast (well under 10 MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000
SEED = 20240229


def words(text: str | Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of the sources: (source, source_size, weight) -> (..., target).

    All targets together are `share` of all sizes and go by weight, but none is above
    most_epochs times its source's size; what exceeds that goes to the others by
    weight. So target = min(weight * level, cap) with one level for all, found from
    running sums over the sources in the order of cap / weight. The table has one
    row a source."""
    cap = F.col("source_size").cast("double") * most_epochs
    t = sources.withColumn("_cap", cap).withColumn("_at", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_at", F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole).cast("double") * F.lit(share)
    t = t.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", F.col("_level").alias("level")))).over(whole)["level"])
    return t.withColumn("target", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("weight") * F.col("_final"), F.col("_cap")))).drop("_cap", "_at", "_level", "_final")


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, most_epochs: int, seed: int, id_col: str, source_col: str, text_col: str, ranges: int) -> tuple[DataFrame, DataFrame]:
    """Sizes, keys and ranges of all rows, and for each source its target, whole
    epochs, the range in which its budget ends and the words left there."""
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text_col).alias("size"), key.alias("key")), "sizes")
    ranged = sized.withColumn("range", bucket_of(F.col("key"), ranges))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sources = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    goals = water_fill(sources.withColumn("weight", F.element_at(listed, (rank % len(weights) + 1).cast("int"))), share, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", epochs.alias("epochs"), F.greatest(rest, F.lit(0)).cast("long").alias("rest"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    cut = running.join(goals, F.col("source").eqNullSafe(F.col("_source"))).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = cut.select(F.col("_source").alias("_cut"), F.col("range").alias("cut_range"), (F.col("rest") - F.col("before")).alias("cut_words"))
    plan = written(goals.join(cut, F.col("_source").eqNullSafe(F.col("_cut")), "left").drop("_cut"), "plan")
    return ranged, F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _taken(ranged: DataFrame, plan: DataFrame) -> DataFrame:
    placed = ranged.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where(F.col("cut_range").isNull() | (F.col("range") != F.col("cut_range"))).withColumn("part", F.when(F.col("cut_range").isNull() | (F.col("range") > F.col("cut_range")), F.lit(0)).otherwise(F.col("size")))
    at_cut = placed.where("range = cut_range").withColumn("_left", F.col("cut_words") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_cut = at_cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))).drop("_left")
    both = whole.union(at_cut.select(*whole.columns))
    copies = F.col("epochs") + F.when((F.col("size") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    return both.select("id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("part")).cast("long").alias("taken"), copies.cast("long").alias("copies"), F.col("range").eqNullSafe(F.col("cut_range")).alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """What the mix takes of each row: (id, source, size, source_size, target, taken, copies, cut).

    A source gives floor(target / source_size) whole epochs of all its rows; the rest
    of its budget goes down its rows in the order of a hash of (id, seed), equal ids by
    size, and is cut exactly where it ends: `taken` counts words, and one row a source
    may be taken in part. `copies` rounds that row to whole texts; `cut` marks the rows
    of the range with the cut.

    The order within a source is a range sort in two levels: rows fall into equal
    ranges of the key; sums of each (source, range) are added up in order; rows are
    sorted only inside the one range in which the budget ends. So no task holds a
    source, however hot, and nothing but sums is shuffled. Sums of words per source
    and range are the only state; the plan of one row a source is broadcast if it has
    at most BROADCAST_SOURCES rows.

    Defined cases: null texts have size 0 and are taken 0 times; null sources are a
    source of their own, last in order; repeated rows are rows of their own; rows
    with equal ids and sizes are equal to the order, so reruns agree; null ids are an
    id; other columns are ignored; an empty table gives an empty table."""
    ranged, plan = _planned(docs, weights, share, most_epochs, seed, id_col, source_col, text_col, ranges)
    return _taken(ranged, plan)


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows themselves, with all their columns: each as many times as it is
    taken, the row at a source's cut whole or not at all, whichever is nearer.

    Texts are never shuffled, but for those of the range with the cut, which find
    their copies by (id, source, size). Defined cases as in mix(); rows of size 0 (null
    texts and texts without words) give as many copies as their source has whole epochs;
    columns may have any names; an empty table gives an empty table."""
    ranged, plan = _planned(docs, weights, share, most_epochs, seed, id_col, source_col, text_col, RANGES)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))  # names of its own from here on
    at = plan.select(F.col("_source"), F.col("epochs"), F.coalesce("cut_range", F.lit(-1)).alias("cut"))
    placed = rows.join(at, F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", bucket_of(F.xxhash64(F.col("id"), F.lit(seed)), RANGES))
    whole = placed.where(F.col("range") != F.col("cut")).select("row", (F.col("epochs") + F.when(F.col("range") < F.col("cut"), 1).otherwise(0)).alias("copies"))
    split = _taken(ranged, plan).where("cut").groupBy(F.col("id").alias("_id"), F.col("source").alias("_of"), F.col("size").alias("_size")).agg(F.max("copies").alias("copies"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_of")) & (words("text") == F.col("_size"))
    parted = placed.where(F.col("range") == F.col("cut")).join(split, same).select("row", "copies")
    every = whole.where("copies > 0").union(parted.where("copies > 0"))
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")

