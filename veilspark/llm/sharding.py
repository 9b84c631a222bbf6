"""Sharding by balanced label propagation.

Documents with equal texts are linked. Since linked documents are exchangeable, the
state of the propagation is not a label for each document but how many documents of
each group stand in each shard: (group, shard, n). A group that holds a third of all
rows is at most `shards` rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import drop_written, prefix_sums, table, written

SHARDS = 24


def capacities(spark: SparkSession, rows: int, shards: int) -> DataFrame:
    """(shard, cap): how many documents each shard holds, at most one apart."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(rows // shards) + (F.col("id") < rows % shards).cast("long")).alias("cap"))


def propagate(state: DataFrame, caps: DataFrame) -> DataFrame:
    """Move documents of (group, shard, n) to the shard where most of their group is.

    Each round, every group picks its fullest part among shards with free places
    (ties by hash), and its smaller parts want to join it. The documents to move are
    admitted in the order of a hash of the group, up to the shard's free places, which
    a prefix sum over each target finds; partial admissions are allowed. So no shard
    ever exceeds its capacity, and each admitted document joins a larger part of its
    group: the number of linked pairs in different shards falls with every round that
    admits any. Stops when nothing is admitted; there is no other bound."""
    while True:
        load = state.groupBy("shard").agg(F.sum("n").alias("load"))
        free = caps.join(load, "shard", "left").select(F.col("shard").alias("_target"), (F.col("cap") - F.coalesce("load", F.lit(0))).alias("free"))
        open_ = state.join(F.broadcast(free), F.col("shard") == F.col("_target"))  # a row a shard
        choice = F.struct((F.col("free") > 0).alias("open"), "n", F.xxhash64("group", "shard").alias("tie"), "shard")
        best = open_.groupBy("group").agg(F.max(choice).alias("best"), F.count("*").alias("parts")).where("parts > 1 AND best.open")
        best = best.select(F.col("group").alias("_group"), F.col("best.shard").alias("target"), F.struct("best.n", "best.tie", "best.shard").alias("_part"))
        smaller = F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard") < F.col("_part")
        wish = state.join(best, F.col("group") == F.col("_group")).where(smaller).select("group", "shard", "n", "target", F.xxhash64("group").alias("key"))
        queued = prefix_sums(wish, ["target"], "key", ["group", "shard"], "n", "ahead")
        admitted = queued.join(F.broadcast(free), F.col("target") == F.col("_target"))  # a row a shard
        admitted = admitted.select("group", "shard", "target", F.least("n", F.greatest(F.col("free") - F.col("ahead"), F.lit(0))).cast("long").alias("move")).where("move > 0")
        moves = written(admitted, "moves")
        if moves.isEmpty():
            drop_written(moves)
            break
        changes = state.union(moves.select("group", "shard", -F.col("move"))).union(moves.select("group", "target", "move"))
        new = written(changes.groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
        drop_written(state)
        drop_written(moves)
        state = new
    return state


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; counts at most one apart.

    Groups are equal texts. A group starts whole in a shard drawn by hash (one larger
    than a shard in as few as hold it); what exceeds the shards' capacities moves on,
    and label propagation brings parts together while any place is free. Where packing
    the groups by size parts fewer pairs, as between full shards, it is taken instead.
    At most `shards` - 1 groups are parted by it; the fewest possible is a bin packing,
    which it does not promise. Rows without equals then fill the places left. Ranks and slots come from two-level prefix sums, so neither a hot
    group nor a shard is ever in one task; texts are read once and never shuffled.

    Defined cases: null texts are texts of their own kind, all equal to each other
    (size 8, crc32 of nothing); null ids and repeated rows are rows like others, equal
    rows being exchangeable; other columns are ignored; an empty table gives an empty
    table. Reruns agree but for the choice among rows equal in id and text."""
    spark = docs.sparkSession
    text = F.col(text_col)
    read = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit("null")).otherwise(F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.crc32(text.cast("binary"))), F.hex(F.octet_length(text)))).alias("group"),
        F.xxhash64(F.col(id_col), text).alias("key"),
    )
    rows = written(read, "rows")
    many = rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    grouped = written(many, "groups")
    total = rows.count()
    caps = capacities(spark, total, shards)
    ranges = min(1 << 20, max(4096, 1 << (total // 50_000).bit_length()))  # some ten thousand rows a range
    whole = F.lit(max(1, -(-total // shards)))
    spread = grouped.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / whole) - 1).cast("int"))))
    start = spread.select("group", F.pmod(F.col("part") + F.pmod(F.xxhash64("group"), F.lit(shards)), F.lit(shards)).cast("int").alias("shard"), F.least(whole, F.col("n") - F.col("part") * whole).cast("long").alias("n"))
    state = settle(propagate(within(written(start, "state"), caps), caps), grouped, caps)
    placed = place(rows, state, caps, ranges)
    slots = prefix_sums(placed.withColumn("one", F.lit(1)), ["shard"], "key", ["id", "text_crc32"], "one", "slot", ranges)
    return slots.select("id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def within(state: DataFrame, caps: DataFrame) -> DataFrame:
    """Cut a start down to the capacities: what exceeds them moves to the shards with room, in order."""
    load = state.groupBy("shard").agg(F.sum("n").alias("load"))
    over = caps.join(load, "shard").where("load > cap")
    if over.isEmpty():
        return state
    excess = prefix_sums(state.withColumn("key", F.xxhash64("group", "shard")), ["shard"], "key", ["group"], "n", "ahead").join(F.broadcast(caps.withColumnRenamed("shard", "_s")), F.col("shard") == F.col("_s"))
    kept = F.least(F.col("n"), F.greatest(F.col("cap") - F.col("ahead"), F.lit(0))).cast("long")
    split = written(excess.select("group", "shard", "key", kept.alias("kept"), (F.col("n") - kept).alias("moved")), "split")
    room = caps.join(split.groupBy("shard").agg(F.sum("kept").alias("load")), "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
    homeless = prefix_sums(split.where("moved > 0").withColumn("all", F.lit(0)), ["all"], "key", ["group", "shard"], "moved", "first")
    end = F.sum("room").over(Window.orderBy("shard"))  # a row a shard
    room = room.withColumn("to", end).select(F.col("shard").alias("_to"), (F.col("to") - F.col("room")).alias("lo"), F.col("to").alias("hi"))
    fits = homeless.join(F.broadcast(room), (F.col("first") < F.col("hi")) & (F.col("first") + F.col("moved") > F.col("lo")))
    moved = fits.select("group", F.col("_to").alias("shard"), (F.least("hi", F.col("first") + F.col("moved")) - F.greatest("lo", "first")).alias("n"))
    merged = written(split.select("group", "shard", F.col("kept").alias("n")).union(moved).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")
    drop_written(state)
    return merged


def pack(sizes: dict[int, int], caps: list[int], level: bool) -> list[tuple[int, int, int, int, int]]:
    """(n, lo, hi, shard, part): of the sizes[n] groups of n rows, the lo-th to the one
    before the hi-th have `part` rows in the shard.

    Sizes fall; groups of a size go whole to the shards with the most room (level) or
    the least that holds one. A group that no shard holds takes the fullest rooms, and
    its rest the smallest that holds it; it closes a shard, so fewer groups than shards
    are parted."""
    free, plan = list(caps), []
    for n in sorted(sizes, reverse=True):
        at, end = 0, sizes[n]
        while at < end and max(free) >= n:
            fit = sorted((s for s in range(len(free)) if free[s] >= n), key=lambda s: (-free[s] if level else free[s], s))
            share = max(1, (end - at) // len(fit)) if level else end
            for s in fit:
                k = min(share, free[s] // n, end - at)
                if k:
                    plan.append((n, at, at + k, s, n))
                    free[s] -= k * n
                    at += k
        for i in range(at, end):
            rest = n
            while rest:
                s = min(range(len(free)), key=lambda s: (free[s] < rest, free[s] if free[s] >= rest else -free[s], s))
                part = min(rest, free[s])
                plan.append((n, i, i + 1, s, part))
                free[s] -= part
                rest -= part
    return plan


def settle(state: DataFrame, grouped: DataFrame, caps: DataFrame) -> DataFrame:
    """The state, or the packing of the groups by size where that parts fewer pairs.

    Groups of a size are exchangeable, so the driver packs their counts: at most
    sqrt(2 x rows) different sizes. The sum of squared parts tells which parts fewer."""
    squares = lambda plan: sum((hi - lo) * part * part for _, lo, hi, _, part in plan)
    sizes = {r["n"]: r["c"] for r in grouped.groupBy("n").agg(F.count("*").alias("c")).collect()}
    room = [r["cap"] for r in caps.orderBy("shard").collect()]
    plan = max((pack(sizes, room, level) for level in (True, False)), key=squares)
    if squares(plan) <= (state.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0):
        return state
    packed = state.sparkSession.createDataFrame(plan, "_n long, lo long, hi long, shard int, part long")
    ranked = prefix_sums(grouped.withColumn("one", F.lit(1)).withColumn("key", F.xxhash64("group")), ["n"], "key", ["group"], "one", "rank")
    placed = ranked.join(F.broadcast(packed), (F.col("n") == F.col("_n")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    new = written(placed.select("group", "shard", F.col("part").alias("n")), "state")
    drop_written(state)
    return new


def place(rows: DataFrame, state: DataFrame, caps: DataFrame, ranges: int) -> DataFrame:
    """Give every row a shard: grouped rows by their rank in the group, others fill up.

    A group stands in at most as many shards as there are, so its intervals are one
    row: two arrays, from which its rows pick by rank."""
    own = Window.partitionBy("group").orderBy("shard")
    ends = state.withColumn("end", F.sum("n").over(own))  # at most one row for each shard in a group
    lists = ends.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("_ends")).select(F.col("group").alias("_g"), "_ends")
    joined = rows.join(lists, F.col("group") == F.col("_g"), "left")
    alone = joined.where("_ends IS NULL").select("id", "size", "text_crc32", "key")
    whole = joined.where("size(_ends) = 1").select("id", "size", "text_crc32", "key", F.col("_ends")[0]["shard"].alias("shard"))
    split = joined.where("size(_ends) > 1").drop("_g")
    ranked = prefix_sums(split.withColumn("one", F.lit(1)).withColumn("deal", F.xxhash64("key", "id")), ["group"], "deal", ["id"], "one", "rank", ranges)
    parted = ranked.select("id", "size", "text_crc32", "key", F.expr("element_at(filter(_ends, e -> e.end > rank), 1).shard").alias("shard"))
    load = state.groupBy("shard").agg(F.sum("n").alias("load"))
    room = caps.join(load, "shard", "left").select("shard", (F.col("cap") - F.coalesce("load", F.lit(0))).alias("room"))
    ends = F.sum("room").over(Window.orderBy("shard"))  # a row a shard
    room = room.select("shard", ends.alias("end")).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("_room"))
    ranked = prefix_sums(alone.withColumn("all", F.lit(0)).withColumn("one", F.lit(1)), ["all"], "key", ["id", "text_crc32"], "one", "rank", ranges)
    filled = ranked.crossJoin(F.broadcast(room)).select("id", "size", "text_crc32", "key", F.expr("element_at(filter(_room, e -> e.end > rank), 1).shard").alias("shard"))  # one row of `shards` intervals
    return whole.union(parted).union(filled)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
