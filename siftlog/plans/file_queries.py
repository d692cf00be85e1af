"""Registered queries of the sources, the index's life and the output, over files and indexes that they write to the shared folder."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from siftlog import render
from siftlog.embed import batch_plan
from siftlog.errors import EngineError
from siftlog.functions import text as T
from siftlog.functions.query import Query, tokens
from siftlog.plans.index import Index, build, check_policy, policy, write
from siftlog.plans.queries import DOC_LINES, EMBEDDER, EVENT_TEXT, QUERIES, ROUTED, _bm25_sql, _lines, _terms, document_lines, event_lines, query, table
from siftlog.plans.search import search
from siftlog.session import drop_path, new_path, ship, written
from siftlog.sources.decode import Limits
from siftlog.sources.expand import expand, fingerprints, qualified, stale
from siftlog.sources.scan import records_of, scan

__all__ = ["QUERIES"]  # importing this module adds to them
PER_FILE = 1000
#: One file for each thousand events, by number.
_FILES = f"SELECT event_id // {PER_FILE} AS part, row_number() OVER (PARTITION BY event_id // {PER_FILE} ORDER BY event_id) AS line_number, event_id, {EVENT_TEXT} AS text FROM events"


def _event_files(spark, sf_dir) -> str:
    """The event log in files of a thousand lines, in folders part=N below a new path."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("event "), F.col("event_id"), F.lit(" user "), F.col("user_id"), F.lit(" did "), F.col("event_type"))
    rows = e.select(F.floor(F.col("event_id") / PER_FILE).alias("part"), "event_id", text.alias("value"))
    path = new_path(spark, "files")
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    full = qualified(path)  # with its scheme, so that it is listed and read as a store
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") else full


def _part():
    return F.regexp_extract("source", r"part=(\d+)/", 1).cast("long").alias("part")


def _here(path: str) -> str:
    """A path of a local file without its scheme; others as they are."""
    return "/" + path.split(":", 1)[1].lstrip("/") if path.startswith("file:") else path


# Sources.
@query(f"SELECT part, line_number, text FROM ({_FILES})")
def s1_scan_folder(spark, sf_dir):
    """All files of a folder, through the file system's own listing and Spark's reader."""
    return scan(spark, _event_files(spark, sf_dir)).select(_part(), "line_number", "text")


@query(f"SELECT part, line_number, sum(length(text) + 1) OVER (PARTITION BY part ORDER BY event_id) - length(text) - 1 AS byte_offset, length(text)::BIGINT AS byte_length, text FROM ({_FILES})")
def s2_scan_ranges(spark, sf_dir):
    """The same files as paths, each read in ranges of 4 KiB, with the place of every line in its file."""
    files = [_here(p) for p in expand([_event_files(spark, sf_dir)]) if "/part-" in p]
    return scan(spark, *files, range_bytes=4096).select(_part(), "line_number", "byte_offset", "byte_length", "text")


@F.pandas_udf(BinaryType())
def _gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: gzip.compress(t.encode(), mtime=0))


_KEPT = "CASE WHEN blank THEN NULL ELSE substr(text, 1, 4096) END AS text, CASE WHEN blank THEN 'empty' END AS skip_reason, NOT blank AND length(text) > 4096 AS truncated"
_DOCS = r"SELECT doc_id, text, NOT regexp_matches(text, '[^ \t\n\r\f\x0B]') AS blank FROM documents WHERE text IS NOT NULL"


@query(f"""SELECT source_index AS doc_id, line_number, false AS array_element, text, skip_reason, truncated FROM ({DOC_LINES}) WHERE source_index % 4 IN (0, 3)
  UNION ALL SELECT doc_id, 1, false, {_KEPT} FROM ({_DOCS}) WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 1, true, {_KEPT} FROM ({_DOCS}) WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 2, true, NULL, 'missing_field', false FROM ({_DOCS}) WHERE doc_id % 4 = 2""")
def s5_dispatch(spark, sf_dir):
    """Lines, JSON Lines, a JSON array and lines in gzip: by the file's extension."""
    ship(spark)
    d = table(spark, sf_dir, "documents").where("text is not null")
    kind, message = F.col("doc_id") % 4, F.to_json(F.struct(F.col("text").alias("message")))
    name = F.concat(F.col("doc_id").cast("string"), F.when(kind == 0, ".log").when(kind == 1, ".jsonl").when(kind == 2, ".JSON").otherwise(".log.gz"))
    content = F.when(kind == 0, F.col("text").cast("binary")).when(kind == 1, F.concat(message, F.lit("\n")).cast("binary")).when(kind == 2, F.concat(F.lit("["), message, F.lit(", 5]")).cast("binary")).otherwise(_gzipped("text"))
    return records_of(d, F.col("doc_id"), name, content).select(F.col("source_index").alias("doc_id"), "line_number", "array_element", "text", "skip_reason", "truncated")


def _packed(kind: int, turns: list[tuple[int, str]]) -> bytes:
    """A zip (0), tar (1) or tar.gz (2) of a folder, a binary file and a file for each turn."""
    out = io.BytesIO()
    files = [("b.bin", b"x\0"), *((f"./t{n}.log", text.encode()) for n, text in turns)]
    if kind == 0:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("folder/"), b"")
            for name, data in files:
                z.writestr(name, data)
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w" if kind == 1 else "w:gz") as t:
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        t.addfile(folder)
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@F.pandas_udf(BinaryType())
def _archive(conv_id: pd.Series, turns: pd.Series) -> pd.Series:
    return pd.Series([_packed(int(c) % 3, [(int(t["turn"]), t["text"]) for t in x]) for c, x in zip(conv_id, turns)])


def _bundles(spark, sf_dir):
    """conv_id, name, content: an archive of each conversation."""
    ship(spark)
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))  # a conversation's own turns
    end = F.when(F.col("conv_id") % 3 == 0, ".zip").when(F.col("conv_id") % 3 == 1, ".tar").otherwise(".TGZ")
    return turns.select("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"), end).alias("name"), _archive("conv_id", "turns").alias("content"))


_END = "CASE conv_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.tar' ELSE '.TGZ' END"
_TURNS = _lines("conversations", "conv_id * 10000 + turn", "text")


@query(f"""SELECT source_index // 10000 AS conv_id, 'c' || conv_id || {_END} || ':t' || source_index % 10000 || '.log' AS source, line_number, text, skip_reason, NULL::BIGINT AS entries
  FROM (SELECT source_index // 10000 AS conv_id, * FROM ({_TURNS}))
  UNION ALL SELECT conv_id, 'c' || conv_id || {_END}, NULL, NULL, unnest(['bundle_directories', 'bundle_binary']), 1 FROM (SELECT DISTINCT conv_id FROM conversations WHERE text IS NOT NULL)""")
def s7_archives(spark, sf_dir):
    """Members in archives' own labels; folders and binary members are counted."""
    b = _bundles(spark, sf_dir)
    rows = records_of(b, F.col("conv_id"), F.col("name"), F.col("content"))
    return rows.select(F.col("source_index").alias("conv_id"), "source", "line_number", "text", "skip_reason", F.when(F.col("line_number").isNull(), F.col("byte_length")).alias("entries"))


@query("""SELECT conv_id, CASE WHEN count(*) + 2 > 6 THEN 'archive_limit' END AS cause FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def s8_archive_limits(spark, sf_dir):
    """Archives of more than six entries are refused."""
    b = _bundles(spark, sf_dir)
    rows = records_of(b, F.col("conv_id"), F.col("name"), F.col("content"), limits=Limits(entries=6), refuse=False)
    cause = F.when(F.col("skip_reason") == "archive_limit", F.col("skip_reason"))
    return rows.groupBy(F.col("source_index").alias("conv_id")).agg(F.max(cause).alias("cause"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'encrypted_archive' WHEN 1 THEN 'corrupt_gzip' WHEN 2 THEN 'corrupt_archive' END AS cause FROM pages""")
def s9_refusals(spark, sf_dir):
    """OpenPGP messages, gzip streams and archives that are none, and good files."""
    p = table(spark, sf_dir, "pages")
    kind, text = F.col("page_id") % 4, F.concat(F.lit("x"), F.coalesce("url", F.lit("")))
    name = F.when(kind == 1, "a.gz").when(kind == 2, "a.tar").otherwise("a.log")
    content = F.when(kind == 0, F.concat(F.lit("-----BEGIN PGP MESSAGE-----\n"), text)).otherwise(text).cast("binary")
    rows = records_of(p, F.col("page_id"), name, content, refuse=False)
    return rows.groupBy(F.col("source_index").alias("page_id")).agg(F.max("skip_reason").alias("cause"))


@query("SELECT page_id, CASE WHEN page_id % 8192 < 4096 THEN 'binary_file' END AS cause FROM pages")
def s10_binary_probe(spark, sf_dir):
    """A NUL among the first 4096 bytes, and further behind."""
    p = table(spark, sf_dir, "pages")
    content = F.expr("concat(repeat('x', cast(page_id % 8192 as int)), cast(unhex('00') as string))").cast("binary")
    return records_of(p, F.col("page_id"), F.lit("a.log"), content, refuse=False).select(F.col("source_index").alias("page_id"), F.col("skip_reason").alias("cause"))


# The mask, on tokens of every class.
@query("""SELECT event_id, 'at <*> from <*> by <*> id <*> block <*> file <*> via /usr/bin/app-x took <*> ms at <*> in <*> ' || event_type AS mask_key FROM events""")
def f2_mask_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    h, n = F.md5(F.col("event_id").cast("string")), F.col("event_id")
    octet = lambda i: F.pmod(F.xxhash64(n, F.lit(i)), F.lit(256)).cast("string")
    part = lambda a, size: F.substring(h, a, size)
    text = F.concat(
        F.lit("at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" from "), F.concat_ws(".", *map(octet, range(4))), F.when(n % 2 == 0, F.concat(F.lit(":"), (n % 65536).cast("string"))).otherwise(""), F.lit(" by fe80::"), part(1, 3),
        F.lit(" id "), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(" block blk_"), F.when(n % 3 == 0, "-").otherwise(""), n.cast("string"), F.lit(" file /var/log/app"), n.cast("string"),
        F.lit("/x.log via /usr/bin/app-x took "), F.when(n % 5 == 0, "-").otherwise(""), n.cast("string"), F.lit(" ms at 0x"), part(1, 8), F.lit(" in 12:34:56 "), F.col("event_type"),
    )
    return e.select("event_id", T.mask_template(text).alias("mask_key"))


_QUOTED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ROUTED))


@query(rf"""WITH q AS (SELECT * FROM (VALUES {_QUOTED}) v(query_id, query)),
t AS (SELECT query_id, generate_subscripts(x, 1) AS n, regexp_replace(unnest(x), '^"(.*)"\z', '\1') AS token FROM (SELECT query_id, string_split_regex(regexp_replace(query, '^"(.*)"\z', '\1'), '[\t\n\r ]+') AS x FROM q))
SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY n) AS place FROM t WHERE token <> ''""")
def f4_query_tokens(spark, sf_dir):
    """The driver's tokenizer of queries."""
    rows = [(i, t, n) for i, q in enumerate(ROUTED) for n, t in enumerate(tokens(q), 1)]
    return spark.createDataFrame(rows, "query_id int, token string, place long")


# The index's life.
def _event_corpus(spark, sf_dir) -> Index:
    """An index of the event log, written and opened again by its path."""
    path = new_path(spark, "corpus")
    write(event_lines(spark, sf_dir), EMBEDDER, path)
    return Index.open(spark, path)


@query(f"""SELECT term, source_index, line_number, count(*) AS tf, any_value(dl)::BIGINT AS dl FROM
  (SELECT event_id AS source_index, 1::BIGINT AS line_number, unnest({_terms(EVENT_TEXT)}) AS term, len({_terms(EVENT_TEXT)}) AS dl FROM events) GROUP BY ALL""")
def k2_corpus_postings(spark, sf_dir):
    p = _event_corpus(spark, sf_dir).postings
    return p.select("term", "source_index", "line_number", F.col("tf").cast("long").alias("tf"), F.col("dl").cast("long").alias("dl"))


@query(f"""WITH t AS (SELECT event_id, {EVENT_TEXT} AS text, array_to_string(list_transform(string_split({EVENT_TEXT}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '<*>' ELSE w END), ' ') AS mask_key FROM events)
SELECT mask_key, arg_min(text, event_id) AS text, min(event_id) AS first_source_index, count(*) AS occurrences FROM t GROUP BY mask_key""")
def k1_corpus_templates(spark, sf_dir):
    return _event_corpus(spark, sf_dir).templates.select("mask_key", "text", "first_source_index", "occurrences")


@query("SELECT count(*) AS lines, count(*) AS kept, count(DISTINCT event_type) AS vectors FROM events")
def s13_corpus_scan(spark, sf_dir):
    """Totals of an index that was opened again, and its vectors."""
    index = _event_corpus(spark, sf_dir)
    return index.vectors.agg(F.lit(index.stats["lines"]).alias("lines"), F.lit(index.stats["kept"]).alias("kept"), F.count("*").alias("vectors"))


@query("SELECT * FROM (VALUES ('same', 'searched'), ('other model', 'search: model_mismatch'), ('other mask', 'searched with a warning'), ('other format', 'corpus_read: unsupported_version'), ('other terms, dense', 'searched'), ('other terms, lexical', 'search: terms_mismatch')) v(index, outcome)")
def i2_policy_checks(spark, sf_dir):
    """An index opened again, with its policy and with one key of it changed (I1 to I4, I9, J6)."""
    from siftlog.plans.index import check_lexical

    found, rows = _event_corpus(spark, sf_dir).policy, []
    for name, change, mode in (("same", {}, "lexical"), ("other model", {"model.sha256": "0"}, "lexical"), ("other mask", {"mask": "0"}, "lexical"), ("other format", {"format": "0"}, "lexical"), ("other terms, dense", {"lexical.terms": "0"}, "dense"), ("other terms, lexical", {"lexical.terms": "0"}, "lexical")):
        try:
            warned = check_policy(found | change, policy(EMBEDDER))
            check_lexical(found | change, mode)
            rows.append((name, "searched with a warning" if warned else "searched"))
        except EngineError as e:
            rows.append((name, f"{e.kind}: {e.cause}"))
    return spark.createDataFrame(rows, "index string, outcome string")


@query("SELECT * FROM (VALUES ('whole', 'as built'), ('with a row more', 'corpus_read: corrupt_file')) v(index, outcome)")
def i9_verify(spark, sf_dir):
    """An index is read against its sums, as it was built and with a row that was added afterwards."""
    path, rows = new_path(spark, "corpus"), []
    write(event_lines(spark, sf_dir), EMBEDDER, path, sums=True)
    for name in ("whole", "with a row more"):
        if name != "whole":
            extra = spark.read.parquet(f"{path}/postings").limit(1).withColumn("term", F.lit("added"))
            written(extra, "extra").write.mode("append").parquet(f"{path}/postings")
        try:
            Index.open(spark, path).verify()
            rows.append((name, "as built"))
        except EngineError as e:
            rows.append((name, f"{e.kind}: {e.cause}"))
    return spark.createDataFrame(rows, "index string, outcome string")


@query(f"""SELECT part, CASE WHEN part = 0 THEN 'missing' WHEN part = 1 THEN 'changed' END AS state FROM (SELECT DISTINCT event_id // {PER_FILE} AS part FROM events)""")
def i5_stale_sources(spark, sf_dir):
    """Of files that were indexed one is deleted and one written anew."""
    path = _event_files(spark, sf_dir)
    before = fingerprints([p for p in expand([path]) if "/part-" in p])
    drop_path(spark, f"{path}/part=0")
    for p in [x[1] for x in before if "/part=1/" in x[1]]:
        jvm = spark.sparkContext._jvm
        f = jvm.org.apache.hadoop.fs.Path(p)
        out = f.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(f, True)
        out.writeBytes("another line\n")
        out.close()
    found = dict(stale([x[1:] for x in before]))
    rows = [(x[1], found.get(x[1])) for x in before]
    return spark.createDataFrame(rows, "source string, state string").select(_part(), "state").distinct()


@query(_bm25_sql(f"SELECT part AS source_index, line_number, text FROM ({_FILES})", Query.of("777").terms) + " SELECT row_number() OVER (ORDER BY contains(text, '777') DESC, bm25::FLOAT DESC, source_index, line_number) AS rank, source_index AS part, line_number, text, bm25::FLOAT AS score FROM sc WHERE bm25 > 0 QUALIFY rank <= 5")
def i1_build_and_search(spark, sf_dir):
    """Files to an index, and a search that opens it by its path: J2, P6 and A12 on the way."""
    path = _event_files(spark, sf_dir)
    files = sorted((p for p in expand([path]) if "/part-" in p), key=lambda p: int(p.split("part=")[1].split("/")[0]))
    out = new_path(spark, "built")
    build(spark, files, out, EMBEDDER)
    found = search(Index.open(spark, out), "777", EMBEDDER, 5, "lexical")
    return found.matches.select(F.col("rank").cast("long").alias("rank"), _part(), F.col("line").alias("line_number"), "text", "score")


# Output.
@query(_bm25_sql(f"SELECT event_id AS source_index, 1::BIGINT AS line_number, {EVENT_TEXT} AS text FROM events", Query.of("777").terms) + """
SELECT '{"schema_version":2,"rank":' || row_number() OVER o || ',"source":"' || source_index || '","kind":"line","line":1,"score":' || '#' || ',"text":"' || text || '","occurrences":' || n || ',"mode":"lexical","dense":null,"lexical":#}' AS shown
FROM (SELECT *, count(*) OVER (PARTITION BY array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '<*>' ELSE w END), ' ')) AS n FROM sc) WHERE bm25 > 0
WINDOW o AS (ORDER BY contains(text, '777') DESC, bm25::FLOAT DESC, source_index, line_number) QUALIFY row_number() OVER o <= 5""")
def k4_json_lines(spark, sf_dir):
    """Results as JSON; # stands for their scores, whose digits SQL would write in another way."""
    rows = search(_event_corpus(spark, sf_dir), "777", EMBEDDER, 5, "lexical", check=False).matches.collect()
    shown = spark.createDataFrame([(render.json_line(r),) for r in rows], "shown string")
    return shown.select(F.regexp_replace("shown", r'("score"|"lexical"):[0-9.eE+-]+', "$1:#").alias("shown"))


@F.pandas_udf(StringType())
def _escaped(text: pd.Series) -> pd.Series:
    return text.map(render.escape)


@query(r"""SELECT conv_id, turn, '\x1B[1m' || replace(replace(replace(text, chr(9), '\x09'), chr(10), '\x0A'), chr(13), '\x0D') || '\x7F\u0085\x00' AS shown FROM conversations""")
def k5_escapes(spark, sf_dir):
    ship(spark)
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", _escaped(F.concat(F.lit("\x1b[1m"), F.col("text"), F.lit("\x7f\x85\x00"))).alias("shown"))


@query("""WITH s AS (SELECT doc_id, coalesce(skip_reason, 'kept') AS reason, truncated FROM (SELECT source_index AS doc_id, skip_reason, truncated FROM (""" + DOC_LINES + """)))
SELECT 'Skipped ' || count(*) FILTER (reason = 'empty') || ' empty line' || CASE WHEN count(*) FILTER (reason = 'empty') = 1 THEN '' ELSE 's' END || '.' AS shown FROM s HAVING count(*) FILTER (reason = 'empty') > 0
UNION ALL SELECT 'Truncated ' || count(*) FILTER (truncated) || ' line' || CASE WHEN count(*) FILTER (truncated) = 1 THEN '' ELSE 's' END || '.' FROM s HAVING count(*) FILTER (truncated) > 0
UNION ALL SELECT 'Indexed ' || count(*) FILTER (reason = 'kept') || ' chunks into ''idx''.' FROM s""")
def k6_messages(spark, sf_dir):
    """What the command line says of a scan, and of an index."""
    from siftlog.errors import Report
    from siftlog.sources.scan import skip_counts

    n = skip_counts(document_lines(spark, sf_dir))
    report = Report(chunks=n["kept"], empty=n["empty"], malformed=n["malformed"], missing_field=n["missing_field"], truncated=n["truncated"])
    return spark.createDataFrame([(m,) for m in [*render.messages(report), render.summary(report, "idx")]], "shown string")


# Embedding batches: lengths of conversations' turns, in blocks of a window.
@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS place FROM conversations""")
def w12_batch_order(spark, sf_dir):
    """The order in which a window's texts are embedded: by length, ties as they came. Each conversation is a window of its own here."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, turns in zip(b["conv_id"], b["turns"]):
                plan = [i for batch in batch_plan([int(t["n"]) for t in turns]) for i in batch]
                rows += [(conv, int(turns[i]["turn"]), n) for n, i in enumerate(plan, 1)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place"])

    ship(spark)
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("turns"))
    return c.mapInPandas(run, "conv_id long, turn long, place long")

