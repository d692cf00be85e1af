"""Z-scores and the hybrid score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
DENSE_WEIGHT, LEXICAL_WEIGHT = 0.8, 0.2
BLOCK = 4096


@dataclass(frozen=True)
class Moments:
    mean: float
    deviation: float


def moments(df: DataFrame, *columns: str) -> list[Moments]:
    """Mean and population deviation of each column, one aggregate job."""
    got = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    return [Moments(got[f"m{i}"] or 0.0, got[f"d{i}"] or 0.0) for i in range(len(columns))]


def weighted_moments(df: DataFrame, column: str, weight: str) -> Moments:
    """Of values that stand for `weight` rows each; the mean first, then the squares around it."""
    x, w = F.col(column), F.col(weight)
    n, total = df.agg(F.sum(w), F.sum(x * w)).first()
    if not n:
        return Moments(0.0, 0.0)
    mean = total / n
    squares = df.agg(F.sum((x - F.lit(mean)) * (x - F.lit(mean)) * w)).first()[0]
    return Moments(mean, (squares / n) ** 0.5)


def moments_with_zeros(df: DataFrame, column: str, n: int) -> Moments:
    """Of the column and as many zeros as make n values."""
    some, mean, deviation = df.agg(F.count(column), F.avg(column), F.stddev_pop(column)).first()
    if not some or not n:
        return Moments(0.0, 0.0)
    whole = mean * some / n
    return Moments(whole, ((some * (deviation * deviation + (mean - whole) ** 2) + (n - some) * whole * whole) / n) ** 0.5)


def stable_moments(df: DataFrame, ordinal: Column, column: str) -> Moments:
    """The same, to the last bit under any partitioning: blocks of 4096 values in the order of a dense ordinal from 0, folded in order.

    A block is one row's array, so no task gathers more than a block, and the driver folds one number for each block.
    """
    block = F.floor(ordinal / BLOCK).alias("block")
    rows = df.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), F.col(column).cast("double").alias("x")))).alias("xs"))
    sums = [r for r in rows.select("block", F.size("xs").alias("n"), F.aggregate("xs", F.lit(0.0), lambda s, v: s + v["x"]).alias("s")).orderBy("block").collect()]
    n = sum(r["n"] for r in sums)
    if not n:
        return Moments(0.0, 0.0)
    mean = 0.0
    for r in sums:
        mean += r["s"]
    mean /= n
    squares = rows.select("block", F.aggregate("xs", F.lit(0.0), lambda s, v: s + (v["x"] - F.lit(mean)) * (v["x"] - F.lit(mean))).alias("s")).orderBy("block").collect()
    total = 0.0
    for r in squares:
        total += r["s"]
    return Moments(mean, (total / n) ** 0.5)


def z_score(x: Column, m: Moments) -> Column:
    """0 where the values don't differ."""
    return F.lit(0.0) if m.deviation == 0.0 else (x - F.lit(m.mean)) / F.lit(m.deviation)


def fused(dense: Column, bm25: Column, coverage: Column, d: Moments, b: Moments) -> Column:
    """The published score is a float, and rows are ordered by it: doubles that round to one float tie."""
    return (F.lit(DENSE_WEIGHT) * z_score(dense, d) + F.lit(LEXICAL_WEIGHT) * z_score(bm25, b) * (coverage * coverage)).cast("float")


def coverage_counts(query_class: str) -> bool:
    return query_class == "natural"
