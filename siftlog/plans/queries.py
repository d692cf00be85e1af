"""Registered queries of the search engine and, where SQL can say the same, their DuckDB SQL. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.embed import HashEmbedder
from siftlog.functions import text as T
from siftlog.functions import vectors as V
from siftlog.functions.query import Query, resolve
from siftlog.operators import bm25, dedup, fusion, metrics, ranking
from siftlog.plans.index import temporary
from siftlog.plans.search import hybrid_scores, search
from siftlog.sources.scan import json_field, lines_of, spread

NATURAL, PHRASE = "the rest of the nation and others", "under the"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def document_lines(spark, sf_dir) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))


def event_lines(spark, sf_dir) -> DataFrame:
    """A log made of events: one line for each, five templates."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("event "), F.col("event_id"), F.lit(" user "), F.col("user_id"), F.lit(" did "), F.col("event_type"))
    return lines_of(e, F.col("event_id"), text)


# SQL that the oracles share.
def _lines(name: str, key: str, text: str) -> str:
    return rf"""
  SELECT source_index, line_number, CASE WHEN blank THEN NULL ELSE substr(v, 1, 4096) END AS text, CASE WHEN blank THEN 'empty' END AS skip_reason, NOT blank AND length(v) > 4096 AS truncated
  FROM (SELECT source_index, line_number, v, NOT regexp_matches(v, '[^ \t\n\r\f\x0B]') AS blank FROM (
    SELECT source_index, line_number, regexp_replace(w, '\r\z', '') AS v FROM (
      SELECT {key} AS source_index, unnest(string_split(regexp_replace({text}, '\n\z', ''), chr(10))) AS w,
             generate_subscripts(string_split(regexp_replace({text}, '\n\z', ''), chr(10)), 1)::BIGINT AS line_number
      FROM {name} WHERE {text} <> '')))"""


RUN = r"(?:[A-Za-z0-9]|[^\x00-\x7F])+"
_LOWER = f"lambda x: translate(x, '{T.UPPER}', '{T.LOWER}')"


def _terms(text: str) -> str:
    return rf"list_transform(list_concat(regexp_extract_all(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g'), '{RUN}'), regexp_extract_all({text}, '{RUN}(?:[-_.:]+{RUN})+')), {_LOWER})"


DOC_LINES = _lines("documents", "doc_id", "text")
EVENT_TEXT = "'event ' || event_id || ' user ' || user_id || ' did ' || event_type"
EVENT_LINES = f"SELECT event_id AS source_index, 1::BIGINT AS line_number, {EVENT_TEXT} AS text FROM events"


def _bm25_sql(source: str, terms: tuple[str, ...], extra: str = "") -> str:
    """CTEs up to sc(source_index, line_number, text, bm25, coverage): all kept lines, the terms added up in order."""
    tf = [f"len(list_filter(terms, lambda x: x = '{t}'))" for t in terms]
    part = [f"CASE WHEN t{i} > 0 THEN ln(1.0::DOUBLE + ((n - d{i})::DOUBLE + 0.5::DOUBLE) / (d{i}::DOUBLE + 0.5::DOUBLE)) * ((t{i}::DOUBLE * 2.5::DOUBLE) / (t{i}::DOUBLE + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl::DOUBLE / (total::DOUBLE / n))))) ELSE 0::DOUBLE END" for i in range(len(terms))]
    return f"""
WITH ln AS ({source}),
tm AS (SELECT source_index, line_number, text, {extra} {_terms('text')} AS terms FROM ln WHERE text IS NOT NULL),
tf AS (SELECT *, len(terms) AS dl, {', '.join(f'{x} AS t{i}' for i, x in enumerate(tf))} FROM tm),
st AS (SELECT count(*) AS n, sum(dl) AS total, {', '.join(f'count(*) FILTER (t{i} > 0) AS d{i}' for i in range(len(terms)))} FROM tf),
sc AS (SELECT tf.*, 0::DOUBLE + {' + '.join(part)} AS bm25, ({' + '.join(f'(t{i} > 0)::INT' for i in range(len(terms)))})::DOUBLE / {len(terms)} AS coverage FROM tf CROSS JOIN st)"""


# Scans and sources.
@query(f"SELECT source_index, line_number, text, skip_reason, truncated FROM ({DOC_LINES})")
def s14_scan_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("source_index", "line_number", "text", "skip_reason", "truncated")


@query(f"""SELECT coalesce(skip_reason, 'kept') AS reason, count(*) AS n, count(*) FILTER (truncated) AS truncated FROM ({DOC_LINES}) GROUP BY 1""")
def a11_skip_counts(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("truncated").alias("truncated"))


@query("""SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props ->> '$.k' END AS text, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN NULL ELSE 'missing_field' END AS skip_reason FROM events""")
def s3_json_field(spark, sf_dir):
    return json_field(table(spark, sf_dir, "events"), F.col("event_id"), F.col("props"), "k").select(F.col("source_index").alias("event_id"), "text", "skip_reason")


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN event_type END AS text,
  CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN event_id % 5 = 0 THEN 'missing_field' END AS skip_reason FROM events""")
def s3_json_lines(spark, sf_dir):
    """Documents with a message, without one, and cut off in the middle."""
    i = F.col("event_id")
    doc = F.when(i % 7 == 0, F.lit('{"message": "')).when(i % 5 == 0, F.lit('{"other": "x"}')).otherwise(F.to_json(F.struct(F.col("event_type").alias("message"))))
    return json_field(table(spark, sf_dir, "events"), i, doc, "message").select(F.col("source_index").alias("event_id"), "text", "skip_reason")


@query("SELECT doc_id, substr(text, 1, 4096) AS text, length(text) > 4096 AS truncated FROM documents")
def f1_limit_value(spark, sf_dir):
    cut = T.limit_value(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", cut["text"].alias("text"), cut["truncated"].alias("truncated"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(translate(p, '\', '/'), '^(?:\./)+', ''), '/+\z', '') AS label, regexp_matches(p, '(?i)\.(?:tar|tgz|tar\.gz|tar\.xz|zip)\z') AS archive, regexp_matches(p, '(?i)\.gz\z') AS gzip
  FROM (SELECT page_id, './' || replace(url, '://', '\') || CASE page_id % 4 WHEN 0 THEN '.TAR.gz' WHEN 1 THEN '.gz' WHEN 2 THEN '/' ELSE '.zip' END AS p FROM pages)""")
def f11_member_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    end = F.when(p.page_id % 4 == 0, ".TAR.gz").when(p.page_id % 4 == 1, ".gz").when(p.page_id % 4 == 2, "/").otherwise(".zip")
    path = F.concat(F.lit("./"), F.replace("url", F.lit("://"), F.lit("\\")), end)
    return p.select("page_id", T.member_name(path).alias("label"), T.is_archive_path(path).alias("archive"), T.is_gzip_path(path).alias("gzip"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def f14_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(f"""SELECT source, source_index, line_number, text FROM (
  SELECT 'documents' AS source, * FROM ({DOC_LINES}) UNION ALL SELECT 'conversations', * FROM ({_lines('conversations', 'conv_id * 1000 + turn', 'text')})
  UNION ALL SELECT 'benchmark', * FROM ({_lines('benchmark', 'item_id', 'text')})) WHERE text IS NOT NULL""")
def u1_multi_source_union(spark, sf_dir):
    c, b = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    parts = [document_lines(spark, sf_dir).withColumn("source", F.lit("documents")), lines_of(c, F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), F.lit("conversations")), lines_of(b, F.col("item_id"), F.col("text"), F.lit("benchmark"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where("skip_reason is null").select("source", "source_index", "line_number", "text")


# Text functions.
@query(f"SELECT conv_id, turn, array_to_string({_terms('text')}, ' ') AS terms, len({_terms('text')}) AS n_terms FROM conversations")
def f3_lexical_terms(spark, sf_dir):
    terms = T.lexical_terms(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("long").alias("n_terms"))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT source_index, line_number, term, count(*) AS tf FROM (SELECT source_index, line_number, unnest({_terms('text')}) AS term FROM ({DOC_LINES}) WHERE text IS NOT NULL) GROUP BY ALL) GROUP BY term")
def a2_term_df(spark, sf_dir):
    return bm25.postings(bm25.with_terms(document_lines(spark, sf_dir))).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT count(*) AS lines, sum(dl)::BIGINT AS total, round(sum(dl) / count(*), 9) AS average FROM (SELECT len({_terms('text')}) AS dl FROM ({DOC_LINES}) WHERE text IS NOT NULL)")
def a3_doc_length(spark, sf_dir):
    rows = bm25.with_terms(document_lines(spark, sf_dir).where("skip_reason is null"))
    return rows.agg(F.count("*").alias("lines"), F.sum("dl").alias("total"), F.round(F.sum("dl") / F.count("*"), 9).alias("average"))


@query()
def f2_mask_template(spark, sf_dir):
    """No SQL: DuckDB's expressions have no look-around. Unit vectors test it."""
    return document_lines(spark, sf_dir).where("skip_reason is null").select("source_index", "line_number", T.mask_template(F.col("text")).alias("mask_key"))


_MASKED = "array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN '<*>' ELSE w END), ' ')"
_ORDERED = "SELECT l_orderkey * 10 + l_linenumber AS source_index, 'order ' || l_orderkey || ' part ' || l_partkey || ' line ' || l_linenumber || ' flag ' || l_returnflag || ' status ' || l_linestatus AS text FROM lineitem"


def _order_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("order "), F.col("l_orderkey"), F.lit(" part "), F.col("l_partkey"), F.lit(" line "), F.col("l_linenumber"), F.lit(" flag "), F.col("l_returnflag"), F.lit(" status "), F.col("l_linestatus"))
    return lines_of(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), text)


@query(f"SELECT mask_key, arg_min(text, source_index) AS text, min(source_index) AS first_source_index, count(*) AS occurrences FROM (SELECT source_index, text, {_MASKED} AS mask_key FROM ({_ORDERED})) GROUP BY mask_key")
def a1_dedup_templates(spark, sf_dir):
    found = dedup.templates(dedup.with_template(_order_lines(spark, sf_dir)))
    return found.select("mask_key", "text", "first_source_index", "occurrences")


@query(f"SELECT source_index, mask_key, count(*) OVER (PARTITION BY mask_key) AS occurrences FROM (SELECT source_index, {_MASKED} AS mask_key FROM ({_ORDERED}))")
def j1_line_occurrences(spark, sf_dir):
    """Every line with its template's count: the join from lines to templates."""
    lines = dedup.with_template(_order_lines(spark, sf_dir))
    t = dedup.templates(lines).select(F.col("distinct_id").alias("t"), "occurrences")
    return lines.join(t, F.col("distinct_id") == F.col("t")).select("source_index", "mask_key", "occurrences")


_TOKENS = r"SELECT DISTINCT unnest(string_split_regex(text, '[\t\n\r ]+')) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)"
_IDENTIFIER = r"""(regexp_full_match(t, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}')
  OR (regexp_full_match(t, '(?:0[xX])?[0-9A-Fa-f]{8,}') AND regexp_matches(regexp_replace(t, '^0[xX]', ''), '[0-9]')) OR regexp_full_match(t, '[0-9]{4,}')
  OR regexp_full_match(t, '[A-Za-z]{2,10}[-_]-?[A-Za-z]?[0-9]{3,}')
  OR regexp_full_match(t, '(?:(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})(?::0*(?:6553[0-5]|655[0-2]\d|65[0-4]\d{2}|6[0-4]\d{3}|[0-5]?\d{1,4}))?')
  OR regexp_full_match(t, '(?:/[^/\s]+){2,}/?'))"""


@query(f"SELECT token, {_IDENTIFIER.replace('(t,', '(token,')} AS identifier FROM ({_TOKENS}) WHERE token <> '' AND NOT regexp_matches(token, '^[0-9A-Fa-f.\\[\\]]*:[0-9A-Fa-f:.\\[\\]]*$')")
def f5_identifier_tokens(spark, sf_dir):
    """Each distinct token of documents and conversations; tokens that could be IPv6 are left to the unit vectors, since the SQL has no pattern for them."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    tokens = texts.select(F.explode(F.split("text", r"[\t\n\r ]+")).alias("token")).distinct().where("token <> ''")
    return tokens.where(~F.col("token").rlike(r"^[0-9A-Fa-f.\[\]]*:[0-9A-Fa-f:.\[\]]*\z")).select("token", T.is_identifier(F.col("token")).alias("identifier"))


ROUTED = ["blk_-70000000000000013", "request failed for ERR-5001", "connection refused", '"10.0.0.1:8080"', "deadbee1", "/var/log/app", "user 1234 left", "", '"two words"', "0xdeadbeef", "12:34"]
_ROUTED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(ROUTED))


@query(rf"""WITH q AS (SELECT * FROM (VALUES {_ROUTED}) v(query_id, query)),
s AS (SELECT query_id, query, regexp_replace(query, '^"(.*)"\z', '\1') AS stripped FROM q),
tk AS (SELECT query_id, regexp_replace(unnest(string_split_regex(stripped, '[\t\n\r ]+')), '^"(.*)"\z', '\1') AS t FROM s),
c AS (SELECT query_id, count(*) AS n, count(*) FILTER ({_IDENTIFIER}) AS ids FROM tk WHERE t <> '' GROUP BY query_id),
k AS (SELECT q.query_id, query, CASE WHEN coalesce(ids, 0) = 0 THEN 'natural' WHEN n = 1 THEN 'identifier' ELSE 'mixed' END AS query_class FROM q LEFT JOIN c USING (query_id))
SELECT query_id, query, query_class, CASE WHEN query_class = 'identifier' THEN 'lexical' ELSE 'hybrid' END AS mode FROM k""")
def f6_auto_route(spark, sf_dir):
    q = spark.createDataFrame(list(enumerate(ROUTED)), "query_id int, query string").withColumn("query_class", T.query_class(F.col("query")))
    return q.withColumn("mode", F.coalesce(*[F.when(F.col("query_class") == c, resolve("auto", c)) for c in ("identifier", "mixed", "natural")]))


# BM25.
_Q = Query.of(NATURAL)


@query(_bm25_sql(DOC_LINES, _Q.terms) + " SELECT source_index, line_number, round(bm25, 9) AS bm25, coverage FROM sc WHERE bm25 > 0")
def a4_bm25_all(spark, sf_dir):
    """By column arithmetic: one pass for the statistics, one for the scores, no shuffle of lines."""
    lines = bm25.with_terms(document_lines(spark, sf_dir).where("skip_reason is null"))
    stats = bm25.statistics(lines, _Q.terms)
    return bm25.scored(lines, stats).where("bm25 > 0").select("source_index", "line_number", F.round("bm25", 9).alias("bm25"), "coverage")


@query(SQL["a4_bm25_all"])
def j3_bm25_postings(spark, sf_dir):
    """The same by inverted postings."""
    lines = bm25.with_terms(document_lines(spark, sf_dir).where("skip_reason is null"))
    posted = bm25.postings(lines)
    totals = lines.agg(F.count("*"), F.sum("dl")).first()
    stats = bm25.statistics_of((totals[0], totals[1]), posted, _Q.terms)
    return bm25.score_postings(posted, stats).where("bm25 > 0").select("source_index", "line_number", F.round("bm25", 9).alias("bm25"), "coverage")


@query(_bm25_sql(DOC_LINES, _Q.terms) + " SELECT row_number() OVER (ORDER BY bm25::FLOAT DESC, source_index, line_number) AS rank, source_index, line_number, bm25::FLOAT AS score, text FROM sc WHERE bm25 > 0 QUALIFY rank <= 5")
def w3_bm25_topk(spark, sf_dir):
    lines = bm25.with_terms(document_lines(spark, sf_dir).where("skip_reason is null"))
    stats = bm25.statistics(lines, _Q.terms)
    rows = bm25.scored(lines, stats).withColumn("score", F.col("bm25").cast("float")).where("score > 0")
    by = ranking.rank_before()
    return ranking.ranked(ranking.top_k(rows, 5, by), by).select(F.col("rank").cast("long").alias("rank"), "source_index", "line_number", "score", "text")


_P = Query.of(PHRASE, "lexical")


@query(_bm25_sql(DOC_LINES, _P.terms) + f" SELECT row_number() OVER (ORDER BY contains(text, '{PHRASE}') DESC, bm25::FLOAT DESC, source_index, line_number) AS rank, source_index, line_number, contains(text, '{PHRASE}') AS substring, bm25::FLOAT AS score FROM sc WHERE bm25 > 0 QUALIFY rank <= 20")
def r3_lexical_mode(spark, sf_dir):
    """Lines that hold the query as it is come first."""
    lines = bm25.with_terms(document_lines(spark, sf_dir).where("skip_reason is null"))
    stats = bm25.statistics(lines, _P.terms)
    rows = bm25.scored(lines, stats).withColumn("score", F.col("bm25").cast("float")).where("score > 0").withColumn("substring", T.contains_exact(F.col("text"), _P.stripped))
    by = ranking.rank_before(substring="substring")
    return ranking.ranked(ranking.top_k(rows, 20, by), by).select(F.col("rank").cast("long").alias("rank"), "source_index", "line_number", "substring", "score")


# Vectors.
def _vector_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, [float(x) for x in e.where("vec_id = 7").first()["embedding"]]


def _vectors_sql(score: str, order: str) -> str:
    return f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, {score} AS score FROM embeddings, q) SELECT row_number() OVER (ORDER BY {order}, vec_id) AS rank, vec_id, round(score, 9) AS score FROM s QUALIFY rank <= 10"


def _vector_topk(spark, sf_dir, f, *order):
    e, q = _vector_query(spark, sf_dir)
    by = [*order, F.col("vec_id")]
    rows = e.select("vec_id", f(F.col("embedding"), V.literal(q)).alias("score"))
    return ranking.ranked(ranking.top_k(rows, 10, by), by).select(F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 9).alias("score"))


@query(_vectors_sql("list_dot_product(embedding::DOUBLE[], e::DOUBLE[])", "score DESC"))
def a7_dense_topk(spark, sf_dir):
    return _vector_topk(spark, sf_dir, V.dot, F.desc("score"))


@query(_vectors_sql("list_sum(list_transform(list_zip(embedding::DOUBLE[], e::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "score"))
def a8_l2_topk(spark, sf_dir):
    return _vector_topk(spark, sf_dir, V.l2_squared, F.asc("score"))


@query(_vectors_sql("list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])", "round(score, 12) DESC"))
def a9_cosine_topk(spark, sf_dir):
    return _vector_topk(spark, sf_dir, V.cosine, F.round("score", 12).desc())


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS d FROM embeddings, q) SELECT vec_id, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 6) AS z FROM s")
def r7_zscore(spark, sf_dir):
    e, q = _vector_query(spark, sf_dir)
    rows = e.select("vec_id", V.dot(F.col("embedding"), V.literal(q)).alias("d"))
    (m,) = fusion.moments(rows, "d")
    return rows.select("vec_id", F.round(fusion.z_score(F.col("d"), m), 6).alias("z"))


@query("""WITH v AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'NaN'::FLOAT WHEN 1 THEN 0.0::FLOAT WHEN 2 THEN -0.0::FLOAT ELSE (vec_id % 3)::FLOAT END AS s FROM embeddings)
SELECT row_number() OVER (ORDER BY isnan(s), s DESC, vec_id) AS rank, vec_id FROM v""")
def w1_rank_order(spark, sf_dir):
    """NaN last, 0 and -0 equal, ties by place."""
    s = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 5 == 1, F.lit(0.0)).when(F.col("vec_id") % 5 == 2, F.lit(-0.0)).otherwise((F.col("vec_id") % 3).cast("double")).cast("float")
    by = ranking.rank_before(place=("vec_id",))
    return ranking.ranked_all(table(spark, sf_dir, "embeddings").select("vec_id", s.alias("score")), by).select("rank", "vec_id")


# Hybrid, routed and grouped search over the event log, with an index.
EMBEDDER = HashEmbedder(32)


def _embed_sql(terms: str) -> str:
    buckets = f"list_transform({terms}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 32)"
    counts = f"list_transform(range(32), lambda i: len(list_filter({buckets}, lambda b: b = i))::DOUBLE)"
    return f"(SELECT list_transform(c, lambda x: CASE WHEN list_sum(list_transform(c, lambda y: y * y)) > 0 THEN (x / sqrt(list_sum(list_transform(c, lambda y: y * y))))::FLOAT::DOUBLE ELSE 0::DOUBLE END) FROM (SELECT {counts} AS c))"


def _hybrid_sql(text: str, mode: str = "auto") -> str:
    q = Query.of(text, mode)
    vector = "[" + ", ".join(f"{x!r}::DOUBLE" for x in EMBEDDER.query(text)) + "]"
    masked = _MASKED + " AS mask_key,"
    first = _bm25_sql(EVENT_LINES, q.terms, masked)
    cover = "coverage * coverage" if q.query_class == "natural" else "1.0::DOUBLE"
    return first + f""",
tp AS (SELECT mask_key AS mk, arg_min(text, source_index) AS ttext, min(source_index) AS first_source, count(*) AS occurrences FROM sc GROUP BY mask_key),
vc AS (SELECT mk, ttext, first_source, occurrences, list_dot_product({_embed_sql(_terms('ttext'))}, {vector}) AS dense FROM tp),
jn AS (SELECT source_index, line_number, text, mask_key, ttext, first_source, occurrences, dense, bm25, coverage FROM sc JOIN vc ON mask_key = mk),
mo AS (SELECT avg(dense) AS dm, stddev_pop(dense) AS dd, avg(bm25) AS bm, stddev_pop(bm25) AS bd FROM jn),
hy AS (SELECT jn.*, (0.8::DOUBLE * CASE WHEN dd = 0 THEN 0::DOUBLE ELSE (dense - dm) / dd END + 0.2::DOUBLE * CASE WHEN bd = 0 THEN 0::DOUBLE ELSE (bm25 - bm) / bd END * ({cover}))::FLOAT AS score FROM jn CROSS JOIN mo)"""


HYBRID, MIXED, GROUPED = "click by the user", "user 1234 did purchase", "event purchase"


def _event_index(spark, sf_dir):
    return temporary(event_lines(spark, sf_dir), EMBEDDER)


def _found(spark, sf_dir, text, k, mode, group=False):
    got = search(_event_index(spark, sf_dir), text, EMBEDDER, k, mode, group, check=False).matches
    return got.select(F.col("rank").cast("long").alias("rank"), F.col("source").cast("long").alias("source_index"), "text", F.round(F.col("score").cast("double"), 4).alias("score"), "occurrences", "mode")


_SHOWN = "SELECT row_number() OVER (ORDER BY score DESC, source_index, line_number) AS rank, source_index, text, round(score::DOUBLE, 4) AS score, occurrences, '{mode}' AS mode FROM {rows} QUALIFY rank <= {k}"


@query(_hybrid_sql(HYBRID) + " SELECT source_index, round(score::DOUBLE, 4) AS score, round(dense, 6) AS dense, round(bm25, 6) AS lexical FROM hy")
def r4_hybrid_scores(spark, sf_dir):
    index, q = _event_index(spark, sf_dir), Query.of(HYBRID)
    stats = bm25.statistics_of((index.stats["lines"], index.stats["total"]), index.postings, q.terms)
    rows = hybrid_scores(index, q, EMBEDDER.query(HYBRID), stats)
    return rows.select("source_index", F.round(F.col("score").cast("double"), 4).alias("score"), F.round("dense", 6).alias("dense"), F.round("lexical", 6).alias("lexical"))


@query(_hybrid_sql(HYBRID) + " " + _SHOWN.format(mode="hybrid", rows="hy", k=10))
def r4_hybrid_topk(spark, sf_dir):
    return _found(spark, sf_dir, HYBRID, 10, "auto")


@query(_hybrid_sql(MIXED) + " " + _SHOWN.format(mode="hybrid", rows="hy", k=10))
def r5_hybrid_mixed(spark, sf_dir):
    """A mixed query: coverage doesn't count."""
    return _found(spark, sf_dir, MIXED, 10, "auto")


@query(_hybrid_sql("zz-999999999", "hybrid") + " " + _SHOWN.format(mode="hybrid", rows="hy", k=10))
def r6_fallback(spark, sf_dir):
    """An identifier that no line holds: lexical falls back to hybrid."""
    return _found(spark, sf_dir, "zz-999999999", 10, "auto")


@query(_hybrid_sql(GROUPED) + ", g AS (SELECT arg_min(first_source, source_index) AS source_index, 1 AS line_number, any_value(ttext) AS text, max(score) AS score, any_value(occurrences) AS occurrences FROM hy GROUP BY mask_key) " + _SHOWN.format(mode="hybrid", rows="g", k=3))
def w8_group_hybrid(spark, sf_dir):
    return _found(spark, sf_dir, GROUPED, 3, "hybrid", True)


@query(_hybrid_sql(GROUPED) + ", g AS (SELECT first_source AS source_index, 1 AS line_number, ttext AS text, dense::FLOAT AS score, occurrences FROM vc) " + _SHOWN.format(mode="dense", rows="g", k=3))
def w7_group_dense(spark, sf_dir):
    return _found(spark, sf_dir, GROUPED, 3, "dense", True)


@query(_hybrid_sql(GROUPED) + ", d AS (SELECT source_index, line_number, text, dense::FLOAT AS score, occurrences FROM jn) " + _SHOWN.format(mode="dense", rows="d", k=7))
def r1_dense_lines(spark, sf_dir):
    return _found(spark, sf_dir, GROUPED, 7, "dense")


@query(_hybrid_sql(GROUPED) + f""", g AS (SELECT any_value(first_source) AS source_index, 1 AS line_number, any_value(ttext) AS text, max(CASE WHEN sub THEN 1 ELSE 0 END) AS sub,
  arg_max(s, (sub::INT * 1000.0 + s)) AS score, any_value(occurrences) AS occurrences FROM (SELECT *, contains(text, '{GROUPED}') AS sub, bm25::FLOAT AS s FROM jn WHERE bm25 > 0) GROUP BY mask_key)
SELECT row_number() OVER (ORDER BY sub DESC, score DESC, source_index) AS rank, source_index, text, round(score::DOUBLE, 4) AS score, occurrences, 'lexical' AS mode FROM g QUALIFY rank <= 3""")
def w9_group_lexical(spark, sf_dir):
    return _found(spark, sf_dir, GROUPED, 3, "lexical", True)


@query(f"""WITH t AS ({_bm25_sql(EVENT_LINES, Query.of('777').terms)} SELECT row_number() OVER (ORDER BY contains(text, '777') DESC, bm25::FLOAT DESC, source_index) AS rank, source_index, text, bm25::FLOAT AS score FROM sc WHERE bm25 > 0 QUALIFY rank <= 5)
SELECT 'line 1: ' || printf('%.4f', score::DOUBLE) || ': ' || text AS shown, rank FROM t""")
def k3_text_lines(spark, sf_dir):
    """Results as lines of text."""
    got = search(_event_index(spark, sf_dir), "777", EMBEDDER, 5, "lexical", check=False).matches
    return got.select(T.line_label(F.col("source"), F.col("kind") == "element", F.col("line"), F.col("score"), F.col("text"), F.lit(False)).alias("shown"), F.col("rank").cast("long").alias("rank"))


# Retrieval quality: each fiftieth vector asks, its label is what is relevant.
_RANKED = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, (label = ql)::INT AS relevant, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
n AS (SELECT query_id, sum(relevant)::BIGINT AS n_relevant FROM s GROUP BY query_id),
h AS (SELECT query_id, min(rank) FILTER (relevant = 1) AS first, count(*) FILTER (relevant = 1) AS hits, list(rank ORDER BY rank) FILTER (relevant = 1) AS ranks FROM r WHERE rank <= 10 GROUP BY query_id),
i AS (SELECT query_id, n_relevant, list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda x: 1.0::DOUBLE / log2(x::DOUBLE + 1))) AS ideal FROM n)
"""


@query(_RANKED + """SELECT i.query_id, round(coalesce(1.0::DOUBLE / first, 0), 9) AS rr, round(CASE WHEN n_relevant = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / least(n_relevant, 10) END, 9) AS recall,
round(CASE WHEN n_relevant = 0 THEN 0 ELSE coalesce(list_sum(list_transform(ranks, lambda x: 1.0::DOUBLE / log2(x::DOUBLE + 1))), 0) / ideal END, 9) AS ndcg FROM i LEFT JOIN h USING (query_id)""")
def metrics_by_query(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", *[F.round(c, 9).alias(c) for c in ("rr", "recall", "ndcg")])


@query(_RANKED + """SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN n_relevant = 0 THEN 0 ELSE coalesce(hits, 0)::DOUBLE / least(n_relevant, 10) END), 6) AS recall_at_10,
round(avg(CASE WHEN n_relevant = 0 THEN 0 ELSE coalesce(list_sum(list_transform(ranks, lambda x: 1.0::DOUBLE / log2(x::DOUBLE + 1))), 0) / ideal END), 6) AS ndcg_at_10 FROM i LEFT JOIN h USING (query_id)""")
def metrics_mrr_recall_ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall_at_10"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_10"))


#: Queries that meet all vectors at a time.
QUERIES_IN_BLOCK = 1024


def _metrics(spark, sf_dir):
    """Queries against all vectors, a block of queries after the other: a task keeps ten rows for each query before anything moves."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("e"), F.col("label").alias("ql"))
    blocks = -(-asked.count() // QUERIES_IN_BLOCK)
    parts = []
    for n in range(max(blocks, 1)):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else asked
        rows = e.crossJoin(F.broadcast(block)).where("vec_id <> query_id").select("query_id", "vec_id", (F.col("label") == F.col("ql")).cast("int").alias("relevant"), V.dot(F.col("embedding"), F.col("e")).alias("score"))
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        parts.append(ranked.where("rank <= 10").select("query_id", "vec_id", "relevant", "rank"))
    top = parts[0]
    for p in parts[1:]:
        top = top.unionByName(p)
    # What is relevant is a matter of labels: no second look at the pairs.
    labels = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n"))
    relevant = asked.join(labels, F.col("ql") == F.col("l"), "left").select("query_id", (F.coalesce("n", F.lit(1)) - 1).alias("n_relevant"))
    return metrics.metrics(top, relevant)


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid search over a log of events at the smallest size."""
    return QUERIES["r4_hybrid_topk"](spark, "/root/testdata/sf0.001")
