"""One order for all results: scores down, NaN last, then the place in the input; substring hits first in lexical mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.session import written

PLACE = ("source_index", "line_number")


def rank_before(score: str = "score", place: tuple[str, ...] = PLACE, substring: str | None = None) -> list[Column]:
    """Spark puts NaN above every number, so a key of its own comes first; 0 and -0 are equal."""
    first = [F.col(substring).desc()] if substring else []
    return [*first, F.isnan(score).asc(), F.col(score).desc(), *[F.col(p).asc() for p in place]]


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Spark keeps k rows for each partition and merges those: nothing is sorted as a whole."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return rows.orderBy(*order).limit(k)


def ranked(best: DataFrame, order: list[Column]) -> DataFrame:
    """rank 1 to k, for rows that are limited already."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_all(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rank from 1 for any number of rows: ranges are sorted each by itself, and numbered from the sum of the ranges before."""
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    # The upper bits of at are the range's number, the others count its rows.
    range_, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(range_.alias("range")).agg((F.max(row) + 1).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return ordered.join(F.broadcast(before), range_ == F.col("range")).withColumn("rank", F.col("before") + row + 1).drop("at", "range", "before")


def best_of_group(rows: DataFrame, order: list[tuple[Column, bool]], group: str = "distinct_id", keep: tuple[str, ...] = ("score", "dense", "lexical")) -> DataFrame:
    """One row for each group: the `keep` columns of its best member, by (key, descending) pairs of numbers and booleans.

    A minimum over a struct of keys is a partial aggregate; a window would bring each group to one task and sort it.
    """
    flip = lambda c, down: -c.cast("double") if down else c
    keys = F.struct(*[flip(c, down).alias(f"k{i}") for i, (c, down) in enumerate(order)])
    return rows.groupBy(group).agg(F.min(F.struct(keys.alias("keys"), F.struct(*keep).alias("row"))).alias("best")).select(group, *[F.col(f"best.row.{c}").alias(c) for c in keep])


def prefixed(kept: DataFrame) -> bool:
    """Whether results name their source: lines of several labels were kept."""
    return len(kept.select("source").distinct().take(2)) > 1


def assert_finite(score: Column) -> Column:
    bad = F.isnan(score) | (F.abs(score) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit("a dense score is not finite")).cast("double")).otherwise(score)
