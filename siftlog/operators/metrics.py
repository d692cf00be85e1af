"""Retrieval quality of ranked results with relevance: reciprocal rank, recall and nDCG for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rr, recall, ndcg. ranked: query_id, rank, relevant (0/1), rows to rank k; relevant: query_id, n_relevant.

    Sums run over a query's k rows in the order of their rank. A query without relevant rows has recall and nDCG 0.
    """
    gain = lambda r: F.lit(1.0) / F.log2(r.cast("double") + 1.0)
    hits = ranked.where((F.col("rank") <= k) & (F.col("relevant") == 1)).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    rows = relevant.join(hits, "query_id", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
    dcg = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + gain(r))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + gain(r))
    none = F.col("n_relevant") == 0
    return rows.select(
        "query_id",
        F.when(F.size("ranks") > 0, F.lit(1.0) / F.element_at("ranks", 1)).otherwise(0.0).alias("rr"),
        F.when(none, 0.0).otherwise(F.size("ranks") / F.least(F.col("n_relevant"), F.lit(k))).alias("recall"),
        F.when(none, 0.0).otherwise(dcg / ideal).alias("ndcg"),
    )
