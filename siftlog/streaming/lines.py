"""Structured Streaming: what needs no statistics of the whole corpus runs on streams as it is; the rest uses a frozen index.

Masking, terms and dense scores are functions of a row. BM25 and z-scores need totals, so a stream is scored against the
totals of an index. Counts of templates are a streaming aggregate, by event-time window with a watermark where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions import vectors
from siftlog.operators import bm25, dedup, ranking
from siftlog.operators.bm25 import Statistics


def templates_by_window(lines: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, mask_key, n: lines of each template by event time; rows later than `late` are dropped with their state."""
    keyed = dedup.with_template(lines.withWatermark(time, late))
    return keyed.where(F.col("mask_key").isNotNull()).groupBy(F.window(time, window), "mask_key").agg(F.count("*").alias("n"))


def scored(lines: DataFrame, stats: Statistics) -> DataFrame:
    """lines with bm25 and coverage against a frozen index's statistics."""
    return bm25.scored(bm25.with_terms(lines), stats)


def dense(lines: DataFrame, vector: Column, query: list[float]) -> DataFrame:
    return lines.withColumn("dense", vectors.dot(vector, vectors.literal(query)))


def top_k_of_batches(rows: DataFrame, k: int, score: str, sink):
    """A streaming query that hands the k best rows of each micro-batch to sink(batch DataFrame, batch id)."""
    return rows.writeStream.foreachBatch(lambda batch, n: sink(ranking.top_k(batch, k, ranking.rank_before(score)), n))
