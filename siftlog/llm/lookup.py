"""A left join with a table of one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import fresh

#: Heaviest keys that are broadcast; a row for each.
HOT = 4096
SALTS = 1024


def heaviest(side: DataFrame, key: str, weight: str, most: int | None = None) -> DataFrame:
    most = HOT if most is None else most
    return side.orderBy(F.desc(weight), key).limit(most)


def look_up(rows: DataFrame, key: str, side: DataFrame, side_key: str, weight: str, spread: Column, most: int | None = None) -> DataFrame:
    """rows with side's other columns, null where side lacks the key. side is read twice.

    The rows of the `most` heaviest keys get theirs from a broadcast; in the shuffle that serves the others they are dealt out by
    spread, so no key's weight beyond the heaviest's falls on one task.
    """
    values = [c for c in side.columns if c != side_key]
    names = fresh([*rows.columns, *side.columns], "hot_key", "salt", "cold_key", "cold_salt", *[f"hot_{c}" for c in values], *[f"cold_{c}" for c in values])
    hot_key, salt, cold_key, cold_salt = names[:4]
    hots, colds = names[4 : 4 + len(values)], names[4 + len(values) :]
    hot = heaviest(side, side_key, weight, most).select(F.col(side_key).alias(hot_key), *[F.col(c).alias(h) for c, h in zip(values, hots)])
    cold = side.select(F.col(side_key).alias(cold_key), F.lit(0).alias(cold_salt), *[F.col(c).alias(x) for c, x in zip(values, colds)])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    is_hot = F.col(hot_key).isNotNull()
    out = out.withColumn(salt, F.when(is_hot, 1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    out = out.join(cold, (F.col(key) == F.col(cold_key)) & (F.col(salt) == F.col(cold_salt)), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.when(is_hot, F.col(h)).otherwise(F.col(x)).alias(c) for c, h, x in zip(values, hots, colds)])
