"""URL filtering by rules and, where none fits, by propagation over the graph of hosts.

Rules name a host and a path: a rule fits its host and all subdomains, where the url's path starts with the rule's, and the
longest rule that fits decides. For all other urls the host decides. Trust starts at hosts whose urls were allowed by a rule
and follows links, as personalised PageRank; distrust starts at hosts whose urls were blocked and follows links backwards,
from a host to those that link to it. A host is blocked if distrust outweighs trust; a host that neither reaches is allowed.

Rules are a table: each host is joined with the rules for it and its parent domains, and pages look their host's rules up. Rows
of pages are never joined by themselves: links are reduced to distinct pairs within a page, then to weighted host edges with
partial sums, and each round of the propagation moves one row for each edge and host. Mass is whole numbers, so the outcome
doesn't depend on the order of adding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.lookup import look_up
from siftlog.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All mass at the start, exact in a double. What is less than one of these parts is lost on the way.
MASS = 10**15
#: Rules up to which a list of them is broadcast.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z in lower case; empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """verdict, rule, rule_host, rule_path of rules (verdict, host/path), given as a list or as a table with these two columns."""
    small = not isinstance(rules, DataFrame)
    table = spark.createDataFrame(rules, "verdict string, rule string") if small else rules.select("verdict", "rule")
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))
    out = table.where("rule is not null").select("verdict", "rule", host.alias("rule_host"), F.when(at > 0, F.col("rule").substr(at, F.length("rule"))).otherwise("").alias("rule_path"))
    return F.broadcast(out) if small and len(rules) <= BROADCAST_RULES else out


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts(host, ...) that have rules, with an array of their rules: struct(size, rule, verdict, path). A host's rules are gathered, not its pages."""
    parts = F.split("host", r"\.", -1)
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))
    exploded = hosts.select("*", F.explode(suffixes).alias("suffix"))
    rule = F.struct(F.length("rule").alias("size"), "rule", "verdict", F.col("rule_path").alias("path"))
    return exploded.join(rules, F.col("suffix") == F.col("rule_host")).groupBy(*hosts.columns).agg(F.collect_list(rule).alias("rules"))


def longest(rules: Column, path: Column) -> Column:
    """The longest rule of an array whose path the path starts with, or null."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(path, r["path"])))


def link_hosts(html: Column, own: Column) -> Column:
    """Distinct other hosts that the page's href attributes lead to; relative links stay on the page's own host."""
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"), 1)
    full = F.filter(F.transform(hrefs, lambda h: F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("http:"), h)).otherwise(h)), lambda h: h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    hosts = F.array_distinct(F.transform(full, host_of))
    return F.filter(hosts, lambda h: (h != "") & (h != own))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, pages: how many pages of src link to dst."""
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("src"), F.col(html_col).cast("string").alias("html")).where("src <> ''")
    return rows.select("src", F.explode(link_hosts(F.col("html"), F.col("src"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """host, trust, distrust, in parts of MASS. seeds: host, allowed, blocked (numbers of pages).

    Mass starts at the seeds, in proportion to their pages, and restarts there with 1 - damping in each round; a host without
    links to follow lets its mass go. Rounds alternate a join on the edge's start and a sum by its end, with partial sums.
    After so many rounds no mass has come further than so many links: a host beyond that has none.
    """
    out = edges.groupBy("src").agg(F.sum("pages").alias("n")).withColumnRenamed("src", "s")
    back = edges.groupBy("dst").agg(F.sum("pages").alias("n")).withColumnRenamed("dst", "s")
    forward = edges.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("pages") / F.col("n")).alias("t"), F.lit(0.0).alias("d"))
    reverse = edges.join(back, F.col("dst") == F.col("s")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("t"), (F.col("pages") / F.col("n")).alias("d"))
    steps = written(forward.unionByName(reverse), "link-steps")
    total = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    part = lambda c, all_: F.floor(F.col(c) / F.lit(float(all_ or 1)) * float(MASS)).cast("long")
    start = written(seeds.where("allowed > 0 or blocked > 0").select("host", part("allowed", total[0]).alias("trust"), part("blocked", total[1]).alias("distrust")), "link-seeds")
    again = start.select("host", *[F.floor(F.col(c) * (1 - damping)).cast("long").alias(c) for c in ("trust", "distrust")])
    if steps.isEmpty():
        return again
    rank = start
    for k in range(rounds):
        moved = steps.join(rank.withColumnRenamed("host", "h"), F.col("src") == F.col("h"))
        moved = moved.select(F.col("dst").alias("host"), *[F.floor(F.col(c) * F.col(w) * damping).cast("long").alias(c) for c, w in (("trust", "t"), ("distrust", "d"))])
        rank = moved.unionByName(again).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % 5 == 4:
            rank = written(rank, "link-rank")
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, threshold: float = 1.0, rounds: int = 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict.

    A host without a rule for the url is blocked if its distrust exceeds threshold times its trust; what a seed is more than
    `rounds` links away from gets nothing of it. Null urls and urls without :// have empty host and path, fit no rule and are
    allowed; null html has no links. Repeated rows count as often as they occur. Other columns are not read. Of rules of one
    length that fit, the last in code point order counts.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("pages")), "link-hosts")
    of_host = written(host_rules(hosts, rule_table(pages.sparkSession, rules)).withColumnRenamed("host", "rule_of"), "link-rules")
    spread = F.struct("page_id", "path")
    fitted = look_up(rows, "host", of_host, "rule_of", "pages", spread).withColumn("fit", longest(F.col("rules"), F.col("path")))
    fitted = written(fitted.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("said")), "link-pages")
    is_ = lambda v: F.sum(F.when(F.col("said") == v, 1).otherwise(0))
    seeds = written(fitted.where("host <> ''").groupBy("host").agg(is_("allow").alias("allowed"), is_("block").alias("blocked"), F.count("*").alias("pages")), "link-seeds")
    rank = propagate(written(host_edges(pages, url_col, html_col), "link-edges"), seeds, rounds)
    bad = rank.where(F.col("distrust") > F.col("trust") * threshold).select(F.col("host").alias("bad_host"))
    bad = written(bad.join(seeds, F.col("bad_host") == F.col("host")).select("bad_host", "pages", F.lit(True).alias("bad")), "link-bad")
    out = look_up(fitted, "host", bad, "bad_host", "pages", spread)
    verdict = F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle(rules: list[tuple[str, str]], rounds: int = 10, damping: float = 0.85, threshold: float = 1.0) -> str:
    """The same as DuckDB SQL over pages(page_id, url, html), one step of the propagation for each round."""
    fits = " UNION ALL ".join(f"SELECT '{r.split('/')[0]}' AS rh, '/{r.partition('/')[2]}' AS rp, '{r}' AS rule, '{v}' AS verdict" for v, r in rules)
    host = lambda u: f"translate(regexp_extract(CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
    sql = rf"""
WITH rules AS ({fits}),
pg AS (SELECT row_number() OVER () AS i, page_id, url, html, {host("url")} AS host,
       CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
       FROM pages),
fit AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM pg JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i),
al AS (SELECT pg.*, rule, verdict FROM pg LEFT JOIN fit USING (i)),
hrefs AS (SELECT i, host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS h FROM pg WHERE host <> ''),
links AS (SELECT DISTINCT i, src, {host("CASE WHEN starts_with(h, '//') THEN 'http:' || h ELSE h END")} AS dst FROM hrefs
          WHERE starts_with(h, '//') OR regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://')),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE dst <> '' AND dst <> src GROUP BY ALL),
steps AS (SELECT src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM edges
          UNION ALL SELECT dst, src, 0.0::DOUBLE, n::DOUBLE / sum(n) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT host, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM al WHERE host <> '' GROUP BY host),
r0 AS (SELECT host, floor(a::DOUBLE / greatest(1, sum(a) OVER ()) * {MASS}::DOUBLE)::BIGINT AS trust, floor(b::DOUBLE / greatest(1, sum(b) OVER ()) * {MASS}::DOUBLE)::BIGINT AS distrust FROM seeds)"""
    for k in range(1, rounds + 1):
        sql += f""",
r{k} AS (SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (
  SELECT dst AS host, floor(trust::DOUBLE * t * {damping}::DOUBLE)::BIGINT AS trust, floor(distrust::DOUBLE * d * {damping}::DOUBLE)::BIGINT AS distrust FROM steps JOIN r{k - 1} ON src = host
  UNION ALL SELECT host, floor(trust::DOUBLE * {1 - damping}::DOUBLE)::BIGINT, floor(distrust::DOUBLE * {1 - damping}::DOUBLE)::BIGINT FROM r0) GROUP BY host)"""
    return sql + f"""
SELECT page_id, al.host, path, rule, coalesce(verdict, CASE WHEN distrust > trust * {threshold} THEN 'block' ELSE 'allow' END) AS verdict
FROM al LEFT JOIN r{rounds} r ON al.host = r.host"""
