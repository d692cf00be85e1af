"""The index: Parquet tables with a policy, written beside their place and moved there when complete."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.embed import MOST_TEXTS, MOST_TOKENS, WINDOW, Embedder
from siftlog.errors import EngineError, Report
from siftlog.functions.text import LINE_LIMIT
from siftlog.operators import bm25, dedup
from siftlog.session import new_path
from siftlog.sources.expand import expand, fingerprints, in_store, qualified, stale
from siftlog.sources.scan import scan, skip_counts

VERSION = "2"
TERMS_VERSION = "1"
#: These must agree, or the vectors of query and corpus don't belong together.
IDENTITY = ("model.id", "model.sha256", "vocab.sha256", "model.quantization", "dimensions")
#: These may differ, with a warning.
COMPARED = ("batch", "truncate", "dedup", "mask", "tokens.max")
TABLES = ("lines", "templates", "vectors", "postings", "sources", "stats", "policy")


# The keys.
def policy(embedder: Embedder) -> dict[str, str]:
    return dict(sorted({
        "batch": f"{MOST_TEXTS} texts or {MOST_TOKENS} tokens of {WINDOW}, short ones first", "bm25": f"k1 {bm25.K1}, b {bm25.B}", "dedup": "by mask, 1", "lexical.terms": TERMS_VERSION,
        "mask": "1", "tokens.max": "256", "truncate": f"{LINE_LIMIT} code points", "format": VERSION, **embedder.identity(),
    }.items()))


def check_policy(found: dict[str, str], current: dict[str, str], path: str = "") -> bool:
    """True where the corpus was built by other rules that only change results a little; raises where it can't be searched."""
    if found.get("format") != VERSION:
        raise EngineError("corpus_read", "unsupported_version", path)
    if any(found.get(k) != current.get(k) for k in IDENTITY):
        raise EngineError("search", "model_mismatch", path)
    return any(found.get(k) != current.get(k) for k in COMPARED)


def check_lexical(found: dict[str, str], mode: str) -> None:
    if mode == "dense":
        return
    if "lexical.terms" not in found:
        raise EngineError("search", "no_postings")
    if found["lexical.terms"] != TERMS_VERSION:
        raise EngineError("search", "terms_mismatch")


class Index:
    """Tables of one corpus: lines, templates, vectors, postings; totals for BM25; sources and policy."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], found_policy: dict[str, str], stats: dict[str, int], path: str = ""):
        self.spark, self.tables, self.policy, self.stats, self.path = spark, tables, found_policy, stats, path
        self.seconds: dict[str, float] = {}  # by stage

    def __getattr__(self, name):
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)

    def stale(self) -> list[tuple[str, str]]:
        return stale([(r["path"], r["size"], r["modified_ns"], r["tracked"]) for r in self.tables["sources"].collect()])

    def verify(self) -> None:
        """Read every table and compare it with the sums that were taken when it was built; an index without sums passes."""
        path = f"{self.path}/sums"
        if not _exists(self.spark, path):
            return
        found = {r["name"]: (r["rows"], r["sum"]) for r in self.spark.read.parquet(path).collect()}
        if found != {t: checksum(self.tables[t]) for t in SUMMED}:
            raise EngineError("corpus_read", "corrupt_file", self.path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """A folder without a policy isn't a corpus: the policy is written last."""
        began = time.perf_counter()
        try:
            found = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/policy").collect()}
            tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES if t not in ("policy", "stats")}
            stats = spark.read.parquet(f"{path}/stats").first().asDict()
        except Exception as e:
            missing = "PATH_NOT_FOUND" in str(e)
            raise EngineError("corpus_read", "file_open" if missing else "corrupt_file", path) from e
        out = cls(spark, tables, found, stats, path)
        out.seconds["corpus-read"] = time.perf_counter() - began
        return out


#: Tables whose content has sums.
SUMMED = ("lines", "templates", "vectors", "postings")


def checksum(table: DataFrame) -> tuple[int, int]:
    """Rows, and a sum of their hashes that doesn't depend on their order."""
    return tuple(table.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*table.columns)), F.lit(0))).first())


def prepare(records: DataFrame) -> DataFrame:
    """Records with template, terms and their number: what all other tables are made of. One pass over the text."""
    return bm25.with_terms(dedup.with_template(records))


def write(records: DataFrame, embedder: Embedder, path: str, sources: list[tuple[int, str, int, int, bool]] = (), keep_text: bool = True, by_term: bool = True, sums: bool = False) -> Index:
    """Write all tables below path. The lines are worked out once; templates, postings and totals are read from what was written.

    Templates are embedded, not lines. Postings are ordered by term, so that a query's terms prune row groups, unless by_term
    is false, as for an index that is searched once. Skipped records stay as lines without a template. With sums the tables
    are read once more, for verify().
    """
    spark, at = records.sparkSession, [time.perf_counter()]
    prepare(records).select("source_index", "source", "line_number", "array_element", "distinct_id", "mask_key", "text" if keep_text else F.lit(None).cast("string").alias("text"), "terms", "dl", "skip_reason", "truncated").write.parquet(f"{path}/lines")
    at.append(time.perf_counter())
    lines = spark.read.parquet(f"{path}/lines")
    dedup.templates(lines).write.parquet(f"{path}/templates")
    templates = spark.read.parquet(f"{path}/templates")
    dedup.check_ids(templates)
    at.append(time.perf_counter())
    embedder.vectors(templates.select("distinct_id", "text")).write.parquet(f"{path}/vectors")
    at.append(time.perf_counter())
    posted = bm25.postings(lines)
    if by_term:
        posted = posted.repartitionByRange("term", "source_index").sortWithinPartitions("term", "source_index", "line_number")
    posted.write.parquet(f"{path}/postings")
    kept = F.col("skip_reason").isNull()
    totals = lines.agg(F.count("*").alias("lines"), F.count_if(kept).alias("kept"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    totals.write.parquet(f"{path}/stats")
    spark.createDataFrame(list(sources), "source_index long, path string, size long, modified_ns long, tracked boolean").coalesce(1).write.parquet(f"{path}/sources")
    if sums:
        spark.createDataFrame([(t, *checksum(spark.read.parquet(f"{path}/{t}"))) for t in SUMMED], "name string, rows long, sum long").coalesce(1).write.parquet(f"{path}/sums")
    spark.createDataFrame(list(policy(embedder).items()), "key string, value string").coalesce(1).write.parquet(f"{path}/policy")
    at.append(time.perf_counter())
    out = Index.open(spark, path)
    out.seconds |= {"parse": at[1] - at[0], "embed": at[3] - at[2], "corpus-write": at[2] - at[1] + at[4] - at[3]}
    return out


def build(spark: SparkSession, paths: list[str], output: str, embedder: Embedder, json_field: str = "message", limits=None) -> Report:
    """Index files into output, or leave output as it was: tables are written to a folder beside it, which is then renamed."""
    began = time.perf_counter()
    files = expand(paths)
    if any(same_place(p, output) for p in files):
        raise EngineError("index_build", "output_is_input", output)
    before = fingerprints(files)
    records = scan(spark, *files, json_field=json_field, limits=limits)
    temporary = f"{output}.tmp-{uuid.uuid4().hex}"
    fs, target, draft = _paths(spark, output, temporary)
    try:
        index = write(records.where("line_number is not null"), embedder, temporary, before, sums=True)
        counts = skip_counts(index.tables["lines"])
        report = Report(chunks=counts["kept"], empty=counts["empty"], malformed=counts["malformed"], missing_field=counts["missing_field"], truncated=counts["truncated"], json_field=json_field)
        if fingerprints(files) != before:
            raise EngineError("index_build", "source_changed", report=report)
        if not report.chunks:
            raise EngineError("empty_input", "nothing_indexable" if report.empty + report.malformed + report.missing_field else "empty_file", files[0] if len(files) == 1 else "", report=report)
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(draft, target):
            raise EngineError("corpus_write", "file_open", output)
    finally:
        fs.delete(draft, True)
    report.seconds = index.seconds | {"index": time.perf_counter() - began}
    return report


def same_place(a: str, b: str) -> bool:
    """Whether two paths that are there are one, also through links or, in a store, through another spelling."""
    if a == "-" or in_store(a) != in_store(b):
        return False
    if in_store(a):
        try:
            return qualified(a) == qualified(b)
        except EngineError:
            return False
    return os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _paths(spark, path)
    return fs.exists(p)


def _paths(spark: SparkSession, *paths: str):
    jvm = spark.sparkContext._jvm
    out = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return out[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *out


def temporary(records: DataFrame, embedder: Embedder) -> Index:
    """An index for one search, in the shared folder."""
    return write(records, embedder, new_path(records.sparkSession, "grep"), by_term=False)
