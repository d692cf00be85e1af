"""Columns that are worked out once, however often they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns added behind a generator of one row.

    The optimizer copies an expression into every filter and projection above it; what a generator puts out it can only
    refer to. It stays in the JVM and in the same stage, and moves no rows.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(row))
