"""Search: classify on the driver, score distinct templates and matching postings, fuse, rank, group."""

from __future__ import annotations

import resource
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.embed import Embedder
from siftlog.errors import EngineError, Report
from siftlog.functions import vectors
from siftlog.functions.query import Query
from siftlog.functions.text import contains_exact
from siftlog.operators import bm25, fusion, ranking
from siftlog.plans.index import Index, check_lexical, check_policy, policy, temporary
from siftlog.sources.expand import expand, is_archive
from siftlog.sources.scan import scan, skip_counts

KEY = ["source_index", "line_number"]


@dataclass
class Result:
    matches: DataFrame  # rank, source, kind, line, score, text, occurrences, mode, dense, lexical
    report: Report


def _dense(index: Index, vector: list[float]) -> DataFrame:
    """distinct_id, dense: one score for each template."""
    score = ranking.assert_finite(vectors.dot(F.col("vector"), vectors.literal(vector)))
    return index.vectors.select(F.col("distinct_id").alias("d_id"), score.alias("dense"))


def _rankable(index: Index) -> DataFrame:
    return index.lines.where(F.col("distinct_id").isNotNull())


#: Places up to which the scan of lines is pruned by a list of them.
LISTED = 1000


def _publish(index: Index, best: DataFrame, order: list, mode: str, group: bool) -> DataFrame:
    """best (k rows: place, distinct_id, score, dense, lexical and what the order asks for) with source, text and occurrences.

    Texts are read here for the first time: the k places, which the driver knows by now, prune the scan of the lines.
    """
    fields = best.schema
    rows = best.collect()
    listed = lambda df, **wanted: df.where(" and ".join(f"{c} in ({', '.join(map(str, sorted(set(v))))})" for c, v in wanted.items())) if 0 < len(rows) <= LISTED else df.limit(len(rows)) if not rows else df
    lines = listed(index.lines, source_index=[r["source_index"] for r in rows], line_number=[r["line_number"] for r in rows])
    lines = lines.select(F.col("source_index").alias("l_s"), F.col("line_number").alias("l_n"), "source", "array_element", F.col("text").alias("l_text"))
    t = listed(index.templates, distinct_id=[r["distinct_id"] for r in rows]).select(F.col("distinct_id").alias("t_id"), F.col("text").alias("t_text"), "occurrences")
    top = F.broadcast(index.spark.createDataFrame(rows, fields))
    full = top.join(lines, (F.col("source_index") == F.col("l_s")) & (F.col("line_number") == F.col("l_n"))).join(t, F.col("distinct_id") == F.col("t_id"))
    text = F.col("t_text") if group else F.coalesce("l_text", "t_text")  # an index may keep the templates' texts alone
    return ranking.ranked(full, order).select(
        "rank", "source", F.when(F.col("array_element"), "element").otherwise("line").alias("kind"), F.col("line_number").alias("line"), F.col("score").cast("float").alias("score"), text.alias("text"), "occurrences",
        F.lit(mode).alias("mode"), F.col("dense").cast("float").alias("dense"), F.col("lexical").cast("float").alias("lexical"),
    ).orderBy("rank")


def _firsts(index: Index) -> DataFrame:
    """Each template with the place of its first line, which is where a group stands."""
    return index.templates.select("distinct_id", F.col("first_source_index").alias("source_index"), F.col("first_line_number").alias("line_number"), "occurrences")


def _of_templates(index: Index, best: DataFrame) -> DataFrame:
    """The lines, without their texts, of templates (d_id, score, dense)."""
    return _rankable(index).select(*KEY, "distinct_id").join(best, F.col("distinct_id") == F.col("d_id")).drop("d_id")


def dense_matches(index: Index, vector: list[float], k: int, group: bool) -> DataFrame:
    """Templates are scored and, with group, ranked by themselves: a scan of lines isn't needed for that.

    Without group the lines of the best templates are ranked: a line's score is its template's, so the k best lines lie in
    the k best templates by score and first place, and only those are joined.
    """
    scored = _firsts(index).join(_dense(index, vector), F.col("distinct_id") == F.col("d_id")).withColumn("score", F.col("dense").cast("float"))
    by = ranking.rank_before()
    best = ranking.top_k(scored.select(*KEY, "distinct_id", "score", "dense", F.lit(None).cast("double").alias("lexical")), k, by)
    if not group:
        few = F.broadcast(best.select(F.col("distinct_id").alias("d_id"), "score", "dense", "lexical"))
        best = ranking.top_k(_of_templates(index, few).select(*KEY, "distinct_id", "score", "dense", "lexical"), k, by)
    return _publish(index, best, by, "dense", group)


def lexical_matches(index: Index, query: Query, stats: bm25.Statistics, k: int, group: bool) -> DataFrame:
    """The postings name each hit's template, so lines are read for one thing only: which of them hold the query as it is."""
    hits = bm25.score_postings(index.postings, stats, keep=("distinct_id",)).where("bm25 > 0")
    holds = _rankable(index).where(contains_exact(F.coalesce("text", F.lit("")), query.stripped)).select(F.col("source_index").alias("h_s"), F.col("line_number").alias("h_n"))
    rows = hits.join(holds, (F.col("source_index") == F.col("h_s")) & (F.col("line_number") == F.col("h_n")), "left")
    rows = rows.select(*KEY, "distinct_id", F.col("bm25").cast("float").alias("score"), F.lit(None).cast("double").alias("dense"), F.col("bm25").alias("lexical"), F.col("h_s").isNotNull().alias("substring"))
    by = ranking.rank_before(substring="substring")
    if group:
        order = [(~F.col("substring"), False), (F.col("score"), True), (F.col("source_index"), False), (F.col("line_number"), False)]
        found = ranking.best_of_group(rows, order, keep=("score", "dense", "lexical", "substring"))
        rows = found.join(_firsts(index), "distinct_id").select(*KEY, "distinct_id", "score", "dense", "lexical", "substring")
    return _publish(index, ranking.top_k(rows, k, by), by, "lexical", group)


def _hybrid_parts(index: Index, query: Query, vector: list[float], stats: bm25.Statistics):
    """(templates with their dense score, hits with theirs, the fused score as a function of (dense, bm25, coverage)).

    Lines without a hit have their template's score and no lexical one, so means and deviations come from the templates, each
    counted as often as it occurs, and from the hits: lines are not read.
    """
    templates = _firsts(index).join(_dense(index, vector), F.col("distinct_id") == F.col("d_id")).drop("d_id")
    hits = bm25.score_postings(index.postings, stats, keep=("distinct_id",))
    d = fusion.weighted_moments(templates, "dense", "occurrences")
    b = fusion.moments_with_zeros(hits, "bm25", index.stats["kept"])
    counts = fusion.coverage_counts(query.query_class)
    score = lambda dense, lexical, share: fusion.fused(dense, lexical, share if counts else F.lit(1.0), d, b)
    of = templates.select(F.col("distinct_id").alias("d_id"), "dense")
    scored = hits.join(of, F.col("distinct_id") == F.col("d_id")).select(*KEY, "distinct_id", score(F.col("dense"), F.col("bm25"), F.col("coverage")).alias("score"), "dense", F.col("bm25").alias("lexical"))
    return templates.withColumn("score", score(F.col("dense"), F.lit(0.0), F.lit(0.0))), scored


def hybrid_scores(index: Index, query: Query, vector: list[float], stats: bm25.Statistics) -> DataFrame:
    """All rankable lines with score, dense and lexical."""
    templates, hits = _hybrid_parts(index, query, vector, stats)
    base = templates.select(F.col("distinct_id").alias("d_id"), F.col("score").alias("t_score"), "dense")
    own = hits.select(F.col("source_index").alias("h_s"), F.col("line_number").alias("h_n"), F.col("score").alias("h_score"), "lexical")
    rows = _of_templates(index, base).join(own, (F.col("source_index") == F.col("h_s")) & (F.col("line_number") == F.col("h_n")), "left")
    return rows.select(*KEY, "distinct_id", F.coalesce("h_score", "t_score").alias("score"), "dense", F.coalesce("lexical", F.lit(0.0)).alias("lexical"))


def hybrid_matches(index: Index, query: Query, vector: list[float], stats: bm25.Statistics, k: int, group: bool) -> DataFrame:
    """The best hits, and the best lines without a hit. The latter lie in templates that have such lines and whose score is no
    less than the k-th best of those: the lines of these templates alone are looked at.
    """
    templates, hits = _hybrid_parts(index, query, vector, stats)
    by = ranking.rank_before()
    columns = (*KEY, "distinct_id", "score", "dense", "lexical")
    hit = hits.groupBy(F.col("distinct_id").alias("n_id")).agg(F.count("*").alias("hits"))
    free = templates.join(hit, F.col("distinct_id") == F.col("n_id"), "left").where(F.col("occurrences") > F.coalesce("hits", F.lit(0))).withColumn("lexical", F.lit(0.0))
    if group:
        order = [(F.isnan("score"), False), (F.col("score"), True), (F.col("source_index"), False), (F.col("line_number"), False)]
        found = ranking.best_of_group(hits.select(*columns).unionByName(free.select(*columns)), order)
        rows = found.join(_firsts(index), "distinct_id").select(*columns)
        return _publish(index, ranking.top_k(rows, k, by), by, "hybrid", True)
    edge = ranking.top_k(free.select("score", *KEY), k, by).select("score").collect()
    worst = edge[-1]["score"] if len(edge) == k else None
    few = free if worst is None else free.where(F.isnan("score") | (F.col("score") >= F.lit(worst))) if worst == worst else free
    few = few.select(F.col("distinct_id").alias("d_id"), "score", "dense", "lexical")
    mine = hits.select(F.col("source_index").alias("h_s"), F.col("line_number").alias("h_n"))
    others = _of_templates(index, few).join(mine, (F.col("source_index") == F.col("h_s")) & (F.col("line_number") == F.col("h_n")), "left_anti")
    rows = ranking.top_k(hits.select(*columns), k, by).unionByName(ranking.top_k(others.select(*columns), k, by))
    return _publish(index, ranking.top_k(rows, k, by), by, "hybrid", False)


def search(index: Index, text: str, embedder: Embedder, k: int = 5, mode: str = "auto", group: bool = False, count_skipped: bool = True, check: bool = True) -> Result:
    """The k best lines, or templates with group. Lexical mode without any hit falls back to hybrid, and says so.

    Statistics for BM25 count skipped lines (as empty ones) unless count_skipped is false, as when files are searched once.
    The dense branch is planned only where a mode needs it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    began, report = time.perf_counter(), Report(grouped=group)
    if check:
        report.policy_mismatch = check_policy(index.policy, policy(embedder), index.path)
        report.stale = index.stale()
    query = Query.of(text, mode)
    check_lexical(index.policy, query.mode)
    report.query_class, report.mode, report.chunks = query.query_class, query.mode, index.stats["kept"]
    if not index.stats["kept"]:
        raise EngineError("no_matches", "empty_corpus", report=report)
    report.multiple_sources = ranking.prefixed(_rankable(index))
    stats = None
    if query.mode != "dense":
        stats = bm25.statistics_of((index.stats["lines"] if count_skipped else index.stats["kept"], index.stats["total"]), index.postings, query.terms)
        if query.mode == "lexical" and not any(stats.df.values()):
            report.lexical_fallback, report.mode = True, "hybrid"
    if report.mode == "lexical":
        found = lexical_matches(index, query, stats, k, group)
    else:
        asked = time.perf_counter()
        vector = embedder.query(text)
        report.seconds["query-embed"] = time.perf_counter() - asked
        if str(len(vector)) != index.policy.get("dimensions"):
            raise EngineError("search", "mismatched_dimensions")
        found = dense_matches(index, vector, k, group) if report.mode == "dense" else hybrid_matches(index, query, vector, stats, k, group)
    report.seconds |= index.seconds
    report.seconds["rank"] = time.perf_counter() - began - report.seconds.get("query-embed", 0.0)
    report.peak_mb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    return Result(found, report)


def grep_records(records: DataFrame, text: str, embedder: Embedder, k: int = 5, mode: str = "auto", group: bool = False) -> Result:
    """Search records once, with an index that lasts as long as the session."""
    index = temporary(records, embedder)
    return search(index, text, embedder, k, mode, group, count_skipped=False, check=False)


class LogSearch:
    """The three verbs over files: grep (search once), index, search."""

    def __init__(self, spark: SparkSession, embedder: Embedder):
        self.spark, self.embedder = spark, embedder

    def scan(self, *paths: str, json_field: str = "message", limits=None) -> DataFrame:
        return scan(self.spark, *paths, json_field=json_field, limits=limits)

    def grep(self, text: str, *paths: str, k: int = 5, mode: str = "auto", group: bool = False, json_field: str = "message", limits=None) -> Result:
        records = self.scan(*paths, json_field=json_field, limits=limits)
        bundles: dict[str, dict[str, int]] = {}
        if any(map(is_archive, expand(list(paths)))):
            for r in records.where("line_number is null").collect():  # a row for each archive and kind of entry
                bundles.setdefault(r["source"], {})[r["skip_reason"].removeprefix("bundle_")] = r["byte_length"]
        index = temporary(records.where("line_number is not null"), self.embedder)
        counts = skip_counts(index.lines)
        report = Report(empty=counts["empty"], malformed=counts["malformed"], missing_field=counts["missing_field"], truncated=counts["truncated"], json_field=json_field, bundles=bundles)
        if not counts["kept"]:
            skipped = report.empty + report.malformed + report.missing_field
            raise EngineError("empty_input", "nothing_indexable" if skipped else "empty_file", paths[0] if len(paths) == 1 else "", report=report)
        out = search(index, text, self.embedder, k, mode, group, count_skipped=False, check=False)
        out.report.__dict__.update({n: getattr(report, n) for n in ("empty", "malformed", "missing_field", "truncated", "json_field", "bundles")})
        return out

    def index(self, output: str, *paths: str, json_field: str = "message", limits=None) -> Report:
        from siftlog.plans.index import build

        return build(self.spark, list(paths), output, self.embedder, json_field, limits)

    def search(self, text: str, path: str, k: int = 5, mode: str = "auto", group: bool = False) -> Result:
        return search(Index.open(self.spark, path), text, self.embedder, k, mode, group)

