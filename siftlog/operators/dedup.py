"""Lines that differ only in variable tokens are one template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.functions.once import computed
from siftlog.functions.text import mask_template

ORDINAL = ("source_index", "line_number")


def with_template(lines: DataFrame) -> DataFrame:
    """lines with mask_key and distinct_id, a hash of it; both null for skipped lines."""
    out = computed(lines, mask_key=mask_template(F.col("text")))
    return out.withColumn("distinct_id", F.when(F.col("mask_key").isNotNull(), F.xxhash64("mask_key")))


def templates(lines: DataFrame) -> DataFrame:
    """distinct_id, mask_key, text, first_source_index, first_line_number, occurrences: one row for each template.

    The text is the first line's. Minima and counts are partial aggregates, so a template that most lines share is no hot spot.
    """
    place = F.struct(*ORDINAL)
    kept = lines.where(F.col("distinct_id").isNotNull())
    found = kept.groupBy("distinct_id", "mask_key").agg(F.min(F.struct(place.alias("place"), "text")).alias("first"), F.count("*").alias("occurrences"))
    return found.select("distinct_id", "mask_key", F.col("first.text").alias("text"), F.col("first.place.source_index").alias("first_source_index"), F.col("first.place.line_number").alias("first_line_number"), "occurrences")


def check_ids(found: DataFrame) -> None:
    """Raises if two mask keys share a hash."""
    clash = found.groupBy("distinct_id").count().where("count > 1").take(1)
    if clash:
        raise ValueError(f"two templates share the id {clash[0][0]}")


def numbered(found: DataFrame) -> DataFrame:
    """templates with first_rank, their order of first occurrence from 0: for reports over few templates, since one task orders them."""
    from pyspark.sql.window import Window

    return found.withColumn("first_rank", F.row_number().over(Window.orderBy("first_source_index", "first_line_number")) - 1)
