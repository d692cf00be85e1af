"""Connected components of a link table, by alternating large and small stars, with joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftlog.session import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones, small: the others and itself) link to the node's least neighbour.

    A hub's neighbours are never gathered: the minimum is a partial aggregate, and the join back can be split.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    near = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links, written, with their number and a sum of their hashes, taken on the way."""
    seen = Observation()
    out = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "links")
    return out, (seen.get["n"], seen.get["x"])


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root for each node of links(u, v), root the least node that it reaches. Raises if rounds don't suffice (they grow with the logarithm of the longest path)."""
    now, mark = _counted(links.select("u", "v").where("u <> v").distinct())
    for _ in range(most_rounds if mark[0] else 0):
        before, seen = now, mark
        now, mark = _counted(_star(_star(now, large=True), large=False))
        dropped(before)
        if mark == seen:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
