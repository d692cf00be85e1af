"""Records as a DataFrame: from files of any kind, here or in a store, large text files in parallel, and from columns of tables."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from siftlog.errors import EngineError
from siftlog.functions.text import is_blank, limit_value
from siftlog.session import ship
from siftlog.sources.decode import PROBE, Limits, lines, lines_from, numbered, of_kind, probe, records
from siftlog.sources.expand import LOCAL, expand, in_store, is_archive, is_gzip, kind_of, qualified

SCHEMA = "source_index long, source string, line_number long, byte_offset long, byte_length long, array_element boolean, text string, skip_reason string, truncated boolean"
_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")])


def _row(i: int, r) -> tuple:
    return i, r.source, r.line_number, r.byte_offset, r.byte_length, r.array_element, r.text, r.skip_reason, r.truncated


#: Bytes of a plain text or JSON Lines file that are read at a time.
RANGE = 64 << 20
#: Bytes that one task reads at most where it reads several parts, and what opening a file counts as.
TASK, OPEN = 16 << 20, 64 << 10


class _Part:
    """A whole file, or with a first line the lines of a file that begin in [start, end)."""

    def __init__(self, index: int, path: str, start: int, end: int, first: int | None):
        self.index, self.path, self.start, self.end, self.first = index, path, start, end, first


class _Parts(InputPartition):
    """Parts (arguments of _Part) that one task reads, one after the other."""

    def __init__(self, parts: list[list]):
        self.parts = parts


def _tasks(parts: list[list], cores: int) -> list[_Parts]:
    """Parts, in their order, in runs of TASK bytes, of less where that would leave cores without work. Each file's first part counts OPEN bytes more."""
    new = [not k or p[1] != parts[k - 1][1] for k, p in enumerate(parts)]
    cost = [p[3] - p[2] + OPEN * n for p, n in zip(parts, new)]
    most = min(TASK, sum(cost) // max(cores, 1))
    out, load = [], 0
    for p, c in zip(parts, cost):
        if not out or load + c > most:
            out.append([])
            load = 0
        out[-1].append(p)
        load += c
    return [_Parts(x) for x in out]


class _Reader(DataSourceReader):
    def __init__(self, parts, options):
        self.parts, self.field, self.cores = parts, options.get("jsonField", "message"), int(options.get("cores", "1"))
        self.limits = Limits(**json.loads(options.get("limits", "{}")))

    def __getstate__(self):
        return self.__dict__ | {"parts": []}  # every task gets a copy of the reader; a list of all parts in each grows with their square

    def partitions(self):
        return _tasks(self.parts, self.cores)

    def read(self, parts) -> Iterator[tuple]:
        for x in parts.parts if parts is not None else []:
            yield from self._part(_Part(*x))

    def _part(self, part: _Part) -> Iterator[tuple]:
        skipped: dict[str, int] = {}
        try:
            with open(part.path, "rb") as f:
                if part.first is None:
                    found = records(part.path, f.read(), self.field, self.limits, skipped)
                else:
                    if not part.start:
                        probe(part.path, f.read(PROBE))
                        f.seek(0)
                    found = of_kind(kind_of(part.path), part.path, ((n, *x) for n, x in enumerate(lines_from(f, part.start, part.end), part.first)), self.field)
                for r in found:
                    yield _row(part.index, r)
        except OSError as e:
            raise EngineError("parse", "file_open", part.path) from e
        for kind, n in skipped.items():  # carried as records of a kind of their own
            yield part.index, part.path, None, None, n, False, None, f"bundle_{kind}", False


class RecordSource(DataSource):
    """spark.read.format("siftlog"): files that lie where all executors reach them. Text and JSON Lines are read in ranges, one line at a time."""

    @classmethod
    def name(cls):
        return "siftlog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(json.loads(self.options.pop("parts")), self.options)  # taken out: the source goes to every task, too


def by_line(path: str) -> bool:
    """Whether a file can be cut at line feeds: neither packed nor one JSON document."""
    return not is_archive(path) and not is_gzip(path) and kind_of(path) != "json"


def _parts(spark: SparkSession, files: list[tuple[int, str]], range_bytes: int) -> list[tuple]:
    """Arguments of _Part. Ranges of files that have several are counted first: one number for each comes to the driver."""
    out, cut = [], []
    for i, p in files:
        size = os.path.getsize(p)
        starts = range(0, max(size, 1), range_bytes)
        if not by_line(p):
            out.append((i, p, 0, size, None))
        elif len(starts) == 1:
            out.append((i, p, 0, size, 1))
        else:
            cut += [(i, p, a, min(a + range_bytes, size)) for a in starts]
    if not cut:
        return out

    def count(batches):
        for b in batches:
            n = []
            for path, start, end in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                with open(path, "rb") as f:
                    n.append(sum(1 for _ in lines_from(f, start, end)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["i", "start", "n"])

    rows = spark.createDataFrame(cut, "i long, path string, start long, end long")
    counts = {(r["i"], r["start"]): r["n"] for r in rows.repartition(min(len(cut), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(count, "i long, start long, n long").collect()}
    last, first = None, 1
    for i, p, a, e in cut:
        first = first if i == last else 1
        out.append((i, p, a, e, first))
        last, first = i, first + counts[i, a]
    return sorted(out)


def scan(spark: SparkSession, *paths: str, json_field: str = "message", limits: Limits | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Records of files, directories, archives and standard input (-), in the order of the arguments.

    Text and JSON Lines files are split, here in ranges and in a store (paths with a scheme) by Spark's own reader; JSON
    documents, gzip streams and archives are a task each. Standard input is read once, as lines.
    """
    ship(spark)
    spark.dataSource.register(RecordSource)
    files = list(enumerate(expand(list(paths))))
    own = [(i, p) for i, p in files if p != "-" and not in_store(p)]
    stored = [(i, p) for i, p in files if in_store(p)]
    piped = [i for i, p in files if p == "-"]
    parts = []
    if own or not files:
        limit = (limits or Limits()).__dict__
        parts.append(spark.read.format("siftlog").option("parts", json.dumps(_parts(spark, own, range_bytes))).option("jsonField", json_field).option("limits", json.dumps(limit)).option("cores", spark.sparkContext.defaultParallelism).load())
    if plain := [(i, p) for i, p in stored if by_line(p)]:
        parts.append(_stored_lines(spark, plain, json_field))
    if whole := [(i, p) for i, p in stored if not by_line(p)]:
        parts.append(_stored_files(spark, whole, json_field, limits))
    if piped:
        data = sys.stdin.buffer.read()
        probe("-", data[:PROBE])
        parts.append(spark.createDataFrame([_row(piped[0], r) for r in lines("-", numbered(data))], SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW.types)], schema=_ARROW)


def records_of(df: DataFrame, index: Column, name: Column, content: Column, json_field: str = "message", limits: Limits | None = None, refuse: bool = True) -> DataFrame:
    """Records of files that are rows: a name, whose extension says what it is, and its bytes.

    With refuse a file that can't be read raises, as scan() does; without, it gives one record whose skip_reason is the cause.
    An archive's entries that gave no records are counted in records of a kind of their own.
    """

    def run(batches):
        for b in batches:
            for i, path, data in zip(*(c.to_pylist() for c in b.columns)):
                skipped: dict[str, int] = {}
                rows = []
                try:
                    rows += [_row(i, r) for r in records(path, data, json_field, limits, skipped)]
                    rows += [(i, path, None, None, n, False, None, f"bundle_{kind}", False) for kind, n in skipped.items()]
                except EngineError as e:
                    if refuse:
                        raise
                    rows = [(i, path, None, None, len(data), False, None, e.cause, False)]
                if rows:
                    yield _batch(rows)

    ship(df.sparkSession)
    return df.select(index.cast("long").alias("i"), name.alias("path"), content.alias("content")).where("content is not null").mapInArrow(run, SCHEMA)


def _numbers(files: list[tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """From a store's spelling of each path to its number and the path as given."""
    return {qualified(p): (i, p) for i, p in files}


def _stored_files(spark: SparkSession, files: list[tuple[int, str]], json_field: str, limits: Limits | None) -> DataFrame:
    known = _numbers(files)
    table = F.broadcast(spark.createDataFrame([(k, i, p) for k, (i, p) in known.items()], "known string, i long, p string"))
    whole = spark.read.format("binaryFile").load([p for _, p in files]).join(table, F.regexp_replace("path", *LOCAL) == F.col("known"))
    return records_of(whole, F.col("i"), F.col("p"), F.col("content"), json_field, limits)


def _stored_lines(spark: SparkSession, files: list[tuple[int, str]], json_field: str) -> DataFrame:
    """Lines of files in a store. Spark's reader cuts them in blocks; each block numbers its own lines, and one row for each, its number of lines and bytes, is added up along the file."""
    known = _numbers(files)
    rows = spark.read.option("lineSep", "\n").text([p for _, p in files]).select(F.regexp_replace(F.col("_metadata.file_path"), *LOCAL).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def number(batches):
        last, n, at = None, 0, 0
        for b in batches:
            places, offsets = [], []
            for path, block, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(2)).to_pylist()):
                if (path, block) != last:
                    last, n, at = (path, block), 0, 0
                n += 1
                places.append(n)
                offsets.append(at)
                at += size + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array(offsets, pa.int64())], names=["path", "block", "value", "place", "at"])

    placed = rows.mapInArrow(number, "path string, block long, value binary, place long, at long")
    end = F.max(F.struct("place", (F.col("at") + F.octet_length("value") + 1).alias("bytes")))
    counts = placed.groupBy("path", "block").agg(end.alias("e"))
    along = Window.partitionBy("path").orderBy("block")
    before = counts.select(F.col("path").alias("b_path"), F.col("block").alias("b_block"), (F.sum("e.place").over(along) - F.col("e.place")).alias("lines"), (F.sum("e.bytes").over(along) - F.col("e.bytes")).alias("bytes"))
    joined = placed.join(before, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block")))

    def run(batches):
        for b in batches:
            rows = []
            for path, n, at, raw in zip(*(c.to_pylist() for c in b.columns)):
                i, p = known[path]
                if n == 1:
                    probe(p, raw[:PROBE])
                elif b"\0" in raw[: max(PROBE - at, 0)]:
                    raise EngineError("parse", "binary_file", p)
                rows += [_row(i, r) for r in of_kind(kind_of(p), p, iter([(n, at, raw)]), json_field)]
            if rows:
                yield _batch(rows)

    return joined.select("path", (F.col("lines") + F.col("place")).alias("n"), (F.col("bytes") + F.col("at")).alias("at"), "value").mapInArrow(run, SCHEMA)


def _finished(rows: DataFrame) -> DataFrame:
    """Limits and skips for rows (source_index, source, line_number, value)."""
    cut, blank = limit_value(F.col("value")), is_blank(F.col("value"))
    return rows.select(
        "source_index", "source", "line_number", F.lit(None).cast("long").alias("byte_offset"), F.octet_length("value").cast("long").alias("byte_length"), F.lit(False).alias("array_element"),
        F.when(~blank, cut["text"]).alias("text"), F.when(blank, "empty").alias("skip_reason"), (~blank & cut["truncated"]).alias("truncated"),
    )


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out to all cores where its files give fewer tasks than that: a Parquet file of one row group is one task.

    A table that is large for its cluster has more splits than cores, and is left as it is. Only for scans: counting the
    partitions of a plan with a shuffle would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def lines_of(df: DataFrame, index: Column, text: Column, source: Column | None = None) -> DataFrame:
    """Lines of a text column: one record for each line of each row, numbered from 1. Null text has none."""
    name = index.cast("string") if source is None else source
    parts = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    rows = df.where(text.isNotNull() & (text != "")).select(index.cast("long").alias("source_index"), name.alias("source"), F.posexplode(parts).alias("p", "v"))
    return _finished(rows.select("source_index", "source", (F.col("p") + 1).cast("long").alias("line_number"), F.regexp_replace("v", r"\r\z", "").alias("value")))


def json_field(df: DataFrame, index: Column, document: Column, field: str, source: Column | None = None) -> DataFrame:
    """A string field of JSON documents in a column, one document for each row: malformed, missing or empty ones are skipped, with the reason."""
    name = index.cast("string") if source is None else source
    value = F.try_parse_json(document)
    path = "$." + field
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.when(kind == "STRING", F.try_variant_get(value, path, "string"))
    reason = F.when(document.isNull() | is_blank(document), "empty").when(value.isNull(), "malformed").when(text.isNull(), "missing_field").when(is_blank(text), "empty")
    cut = limit_value(text)
    return df.select(
        index.cast("long").alias("source_index"), name.alias("source"), F.lit(1).cast("long").alias("line_number"), F.lit(None).cast("long").alias("byte_offset"), F.octet_length(document).cast("long").alias("byte_length"),
        F.lit(False).alias("array_element"), F.when(reason.isNull(), cut["text"]).alias("text"), reason.alias("skip_reason"), F.coalesce(reason.isNull() & cut["truncated"], F.lit(False)).alias("truncated"),
    )


def skip_counts(records: DataFrame) -> dict[str, int]:
    """Counters of one scan: kept, truncated, and each reason to skip."""
    kept = F.col("skip_reason").isNull()
    r = records.agg(F.count_if(kept).alias("kept"), F.count_if("truncated").alias("truncated"), *[F.count_if(F.col("skip_reason") == x).alias(x) for x in ("empty", "malformed", "missing_field")]).first()
    return r.asDict()
