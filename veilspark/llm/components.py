"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import drop_written, written

#: The steps converge in about the square of the logarithm of the longest path.
MOST_ROUNDS = 60


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (u, v) but the smallest of each
    component, whose name the component bears.

    Every step is an aggregation with partial sums and a join whose skewed
    partitions Spark can split, for which the aggregate is written first: else the
    join would sit on the aggregate's dealing. So a hub with very many neighbours is
    never gathered in one task. Each round is written, which cuts the lineage."""
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = _sign(e)
    for _ in range(MOST_ROUNDS):
        if not sign[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        lows = [low, written(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "low")]
        low = lows[1]
        small = large.join(low, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        new = written(small, "edges")
        for done in (large, e, *lows):
            drop_written(done)
        e, before, sign = new, sign, _sign(new)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
