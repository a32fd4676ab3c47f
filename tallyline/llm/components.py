"""Connected components of an edge table by alternating stars, each round a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import forget, written


#: Edges up to which a round is one task's work, without any exchange.
ONE_TASK = 100_000


def _star(edges: DataFrame, large: bool, spread: bool) -> DataFrame:
    """Hook neighbours onto the least of a vertex's neighbourhood: the larger ones, or the smaller ones and itself.

    Spread, the least neighbour is combined before its exchange, and the join back to the neighbours
    is a plain one, which adaptive execution splits where a vertex has very many.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both if large else both.where("v < u")
    sides = sides if spread else sides.coalesce(1)
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(u, label) of every vertex with an edge; the label is the least vertex that it reaches.

    Every round is written to the shared folder, so a lost executor costs that round's rest alone.
    """
    now = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").where("u <> v").distinct(), "stars")
    mark, spread = None, now.count() > ONE_TASK
    for _ in range(most_rounds):
        after = written(_star(_star(now, True, spread), False, spread), "stars")
        forget(now)
        now = after
        seen = tuple((now if spread else now.coalesce(1)).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.select("u", F.col("v").alias("label")).union(now.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())
