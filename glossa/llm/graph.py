"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.runtime import forget, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v), long -> (node, root) for every node of an edge that joins two nodes, root being
    the smallest node of its component. Self loops, repeats and both directions are allowed; nulls
    are ignored. Hubs are safe: minima are pre-aggregated and written, so that both inputs
    of each join are plain shuffles, which adaptive execution splits when skewed. Raises RuntimeError if max_rounds doesn't suffice."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e)
    seen = _digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.union(e.select("v", "u"))
        low = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _digest(new)
        forget(e)
        e, done, seen = new, now == seen, now
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
