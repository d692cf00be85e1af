"""Distances between vectors, as Column expressions over arrays (exact, in the order of the elements) and as a numpy function for many rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _same_width(a: Column, b: Column, value: Column) -> Column:
    """An error for vectors of different or no width."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(ok, value).otherwise(F.raise_error(F.lit("vectors must have the same width, at least 1")).cast("double"))


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _same_width(a, b, _fold(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _same_width(a, b, _fold(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    aa, bb = _fold(a, a, lambda x, y: x * y), _fold(b, b, lambda x, y: x * y)
    return _same_width(a, b, F.when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(_fold(a, b, lambda x, y: x * y) / (F.sqrt(aa) * F.sqrt(bb))))


def normalized(a: Column) -> Column:
    norm = F.sqrt(_fold(a, a, lambda x, y: x * y))
    return F.when(norm > 0, F.transform(a, lambda x: (x / norm).cast("float"))).otherwise(a)


def fast_dot(query: list[float]):
    """A Pandas UDF for scans over very many vectors: whole Arrow batches through numpy. Sums may differ from dot() in the last bits."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(np.stack(v.to_numpy()).astype(np.float64) @ q) if len(v) else pd.Series([], dtype="float64")

    return score


def register(spark) -> None:
    sums = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    body = f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) AND size(a) > 0 THEN {sums} ELSE CAST(raise_error('vectors must have the same width, at least 1') AS DOUBLE) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
