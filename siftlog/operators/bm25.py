"""Okapi BM25 over lines, by column arithmetic or by inverted postings. Both add the query's terms up in the order of their bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions.once import computed
from siftlog.functions.text import lexical_terms

# Fixed values.
K1, B = 1.5, 0.75
KEY = ("source_index", "line_number")


@dataclass(frozen=True)
class Statistics:
    lines: int
    total: int  # terms of all lines, repeats included
    df: dict[str, int]

    @property
    def average(self) -> float:
        return self.total / self.lines if self.lines else 0.0


def with_terms(lines: DataFrame) -> DataFrame:
    """lines with terms and dl, their number; skipped lines have none."""
    return computed(lines, terms=F.coalesce(lexical_terms(F.col("text")), F.array().cast("array<string>"))).withColumn("dl", F.size("terms"))


def postings(lines: DataFrame) -> DataFrame:
    """term, source_index, line_number, tf, dl, and the line's distinct_id where lines have one: one row for each distinct term of a line.

    No shuffle: a line's terms are sorted within its row, and the distance from one run's start to the next is its tf.
    """
    more = [c for c in ("distinct_id",) if c in lines.columns]
    rows = computed(lines.select(*KEY, *more, "dl", "terms"), sorted=F.array_sort("terms"))
    first = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.get("sorted", i - 1) != F.get("sorted", i - 2)))
    rows = computed(rows.where("dl > 0"), first=first)
    place = rows.select(*KEY, *more, "dl", "sorted", "first", F.posexplode("first").alias("k", "at"))
    after = F.coalesce(F.get("first", F.col("k") + 1), F.col("dl") + 1)
    return place.select(F.get("sorted", F.col("at") - 1).alias("term"), *KEY, (after - F.col("at")).alias("tf"), "dl", *more)


def statistics(lines: DataFrame, terms: tuple[str, ...], count_skipped: bool = False) -> Statistics:
    """One pass over lines (terms, dl): number of lines, of terms, and of lines that hold each query term."""
    rows = lines if count_skipped else lines.where(F.col("distinct_id").isNotNull()) if "distinct_id" in lines.columns else lines
    has = [F.count_if(F.array_contains("terms", t)).alias(f"d{i}") for i, t in enumerate(terms)]
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), *has).first()
    return Statistics(got["n"], got["total"], {t: got[f"d{i}"] for i, t in enumerate(terms)})


def statistics_of(index_stats: tuple[int, int], posted: DataFrame, terms: tuple[str, ...]) -> Statistics:
    """The same from an index: its stored totals, and the query terms' rows of the postings alone."""
    df = {r["term"]: r["n"] for r in posted.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("n")).collect()} if terms else {}
    return Statistics(*index_stats, {t: df.get(t, 0) for t in terms})


def idf(n: int, df: int) -> Column:
    """Worked out by Spark, so that every platform has one logarithm; constant folding does it once."""
    return F.log(F.lit(1.0) + (F.lit(float(n - df)) + 0.5) / (F.lit(float(df)) + 0.5))


def weight(tf: Column, dl: Column, average: float) -> Column:
    norm = F.lit(1.0 - B) + F.lit(B) * (dl.cast("double") / F.lit(average))
    return (tf.cast("double") * F.lit(K1 + 1.0)) / (tf.cast("double") + F.lit(K1) * norm)


def score(terms: Column, dl: Column, stats: Statistics) -> Column:
    """BM25 of a line from its own terms: a few expressions for each query term, no shuffle."""
    out = F.lit(0.0)
    for t, n in stats.df.items():
        tf = F.size(F.filter(terms, _equals(t)))
        out = out + F.when(tf > 0, idf(stats.lines, n) * weight(tf, dl, stats.average)).otherwise(F.lit(0.0))
    return out if stats.lines and stats.total else F.lit(0.0)


def _equals(t: str):
    return lambda x: x == F.lit(t)


def coverage(terms: Column, query: tuple[str, ...]) -> Column:
    """Share of the query's distinct terms that a line holds."""
    if not query:
        return F.lit(0.0)
    hits = sum((F.array_contains(terms, t).cast("int") for t in query), F.lit(0))
    return hits.cast("double") / F.lit(float(len(query)))


def scored(lines: DataFrame, stats: Statistics) -> DataFrame:
    """lines (terms, dl) with bm25 and coverage, worked out once for all that filters and sorts by them."""
    return computed(lines, bm25=score(F.col("terms"), F.col("dl"), stats), coverage=coverage(F.col("terms"), tuple(stats.df)))


def score_postings(posted: DataFrame, stats: Statistics, keep: tuple[str, ...] = ()) -> DataFrame:
    """source_index, line_number, bm25, coverage, and keep's columns, of the lines that hold a query term, from the inverted postings.

    Only the query terms' postings are read: the filter reaches the Parquet scan. A line has at most one row for each query
    term, which is all that is gathered by line.
    """
    terms = tuple(stats.df)
    hits = posted.where(F.col("term").isin(*terms)) if terms else posted.where(F.lit(False))
    idf_of = F.coalesce(*[F.when(F.col("term") == t, idf(stats.lines, n)) for t, n in stats.df.items()], F.lit(0.0))
    part = idf_of * weight(F.col("tf"), F.col("dl"), stats.average or 1.0)
    rows = hits.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"), *[F.first(c).alias(c) for c in keep])
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])
    return rows.select(*KEY, total.alias("bm25"), (F.size("parts").cast("double") / F.lit(float(max(len(terms), 1)))).alias("coverage"), *keep)
