"""Mix sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document is first taken floor(target / source size) times: these whole copies
are certain. What is left of the target is drawn without replacement, with inclusion probabilities proportional to size,
pi = min(1, lambda * size), where lambda makes the expected words equal to the rest. Documents are ranked by their random
odds divided by their inclusion odds, Q = (u / (1 - u)) / (pi / (1 - pi)), and the sample is the prefix of that order whose
words come nearest to the rest: a sample of fixed size, in words. v = Q / (1 + Q) orders like Q and lies in [0, 1].

Nothing sorts a source in one place: two histograms of v, 4096 cells each, narrow the border down to one cell of a cell,
and only its rows, a 16-millionth of the source, are ordered. All sums that decide are of whole numbers, so the outcome
doesn't depend on how rows are dealt out, and u is a hash of seed and id, so reruns agree.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.llm.chunks import fresh
from siftlog.session import written

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
#: Sources whose per-source figures are broadcast (at about 200 bytes each, 20 MB); with more of them the joins shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """52 bits of a hash, in the open interval (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _targets(sources: DataFrame, weights: tuple[int, ...] | dict, share: Fraction, cap: int) -> DataFrame:
    """Water-filling: sorted by the level at which they are full, sources 1 to j are full, and the rest share by weight."""
    if isinstance(weights, dict):
        w = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(v)) for k, v in weights.items()], F.lit(0))
    else:
        turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
        w = F.element_at(F.array(*[F.lit(x) for x in weights]), turn.cast("int") + 1)
    big = lambda c: c.cast("decimal(38,0)")
    by_level = Window.orderBy((F.col("source_size") * cap / F.col("w")).asc_nulls_first(), F.col("source").asc_nulls_last())
    upto, all_ = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    t = sources.select("source", "source_size", w.cast("long").alias("w"))
    t = t.select("*", F.sum("source_size").over(all_).alias("total"), F.sum("w").over(all_).alias("all_w"), F.coalesce(F.sum("source_size").over(upto) - F.col("source_size"), F.lit(0)).alias("full_size"), (F.sum("w").over(upto) - F.col("w")).alias("full_w"))
    num, den = share.numerator, share.denominator
    left = big(F.col("total")) * num - big(F.col("full_size")) * (den * cap)
    room = F.col("all_w") - F.col("full_w")
    # Once one source stays below its cap all later ones do, at that source's level.
    below = (F.col("w") == 0) | (left * F.col("w") <= big(F.col("source_size")) * (den * cap) * room)
    t = t.select("*", below.alias("below"), F.when(F.col("w") > 0, left.cast("double")).alias("left"), F.when(F.col("w") > 0, (room * den).cast("double")).alias("room"))
    first = F.struct(F.col("source_size") * cap / F.col("w"), F.col("source").isNull(), "source")
    level = lambda c: F.min_by(F.when(F.col("below") & (F.col("w") > 0), F.col(c)), F.when(F.col("below") & (F.col("w") > 0), first)).over(all_)
    t = t.select("*", level("left").alias("left1"), level("room").alias("room1"))
    target = F.when(F.col("below"), F.coalesce(F.col("w") * F.col("left1") / F.col("room1"), F.lit(0.0))).otherwise((F.col("source_size") * cap).cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def _with(df: DataFrame, side: DataFrame, small: bool, on: str = "source") -> DataFrame:
    """df with its source's figures. Where they are too many to broadcast, each source's rows are dealt to SALTS keys."""
    side = side.withColumnRenamed(on, "__side")
    same = F.col(on).eqNullSafe(F.col("__side"))
    if small:
        return df.join(F.broadcast(side), same, "inner").drop("__side")
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    side = side.withColumn("__key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(side, same & (F.col("__salt") == F.col("__key")), "inner").drop("__side", "__salt", "__key")


def _border(cells: DataFrame, cell: str, base: Column) -> DataFrame:
    """For each source the first cell at whose end the words exceed the rest: all before it are in, all behind it are out."""
    w = Window.partitionBy("source").orderBy(cell)
    upto = cells.withColumn("upto", F.sum("words").over(w) + base)
    over = F.col("upto") > F.col("rest")
    return upto.where(over).groupBy("source").agg(F.min(cell).alias(cell + "_border"), F.min_by(F.col("upto") - F.col("words"), cell).alias(cell + "_base"))


def mix(docs: DataFrame, weights: tuple[int, ...] | dict = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """One row for each input row: doc_id, source, digest (MD5 of the text), size, source_size, target, copies, taken.

    size is the number of words, 0 for null or blank text. Sources in code point order, null last (a source of its own), weigh
    as weights repeats, or as the dict says (others: 0). They share `share` times all words by weight; a target stops at cap
    times its source's words and the excess is shared again. copies is at most cap. Rows that repeat id, source and text are
    one unit of the draw and get the same copies; ids may be null or repeat. Documents without words are never drawn, only
    copied whole. No rows give no rows; where no source has words every target is 0.
    """
    share = Fraction(share).limit_denominator(1000)
    text = F.col(text_col).cast("string")
    # The texts are read once: everything below works on this narrow table.
    units = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"), words(text).alias("size")).groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("rows")),
        "mix-units",
    )
    sources = written(_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, cap), "mix-sources")
    small = sources.count() <= broadcast_sources
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    # lambda: documents at which it reaches 1 are certain; sizes from the largest down, one row for each size of a source.
    sizes = _with(units.where("size > 0").groupBy("source", "size").agg(F.sum("rows").alias("n")), plan, small)
    big = lambda c: c.cast("decimal(38,0)")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    all_ = Window.partitionBy("source")
    linear, square = big(F.col("n")) * F.col("size"), big(big(F.col("n")) * F.col("size")) * F.col("size")
    s = sizes.select("source", "size", "rest", (F.sum(linear).over(down) - linear).alias("certain"), (F.sum(square).over(all_) - F.sum(square).over(down) + square).alias("square"))
    s = s.withColumn("lam", (F.col("rest") - F.col("certain").cast("double")) / F.col("square").cast("double"))
    lam = s.where(F.col("lam") * F.col("size") < 1).groupBy("source").agg(F.max_by("lam", "size").alias("lam"))
    plan = written(plan.join(lam.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix-plan")

    u = uniform(F.col("doc_id"), seed)
    pi = F.least(F.lit(1.0), F.col("lam") * F.col("size"))
    a, b = u * (1 - pi), (1 - u) * pi
    ranked = _with(units, plan, small).withColumn("words", F.col("size") * F.col("rows")).withColumn("v", F.when((F.col("rest") > 0) & (F.col("size") > 0) & (pi > 0), a / (a + b)))
    inside = ranked.where("v is not null").withColumn("c1", F.floor(F.col("v") * CELLS)).withColumn("c2", F.floor(F.col("v") * (CELLS * CELLS)))
    one = _border(inside.groupBy("source", "rest", "c1").agg(F.sum("words").alias("words")), "c1", F.lit(0))
    in_one = _with(inside, one, small).where("c1 = c1_border")
    two = _border(in_one.groupBy("source", "rest", "c1_base", "c2").agg(F.sum("words").alias("words")), "c2", F.col("c1_base"))
    last = _with(in_one, two, small).where("c2 = c2_border")
    order = F.struct(F.col("v"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.col("digest"), F.col("size"))
    w = Window.partitionBy("source").orderBy(order)
    before = F.sum("words").over(w) - F.col("words") + F.col("c2_base")
    taken = last.withColumn("before", before).withColumn("key", order).where(2 * F.col("before") + F.col("words") <= 2 * F.col("rest"))
    border = two.select("source", "c2_border").join(taken.groupBy(F.col("source").alias("__s")).agg(F.max("key").alias("last")), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    cut = plan.join(border.withColumnRenamed("source", "__b"), F.col("source").eqNullSafe(F.col("__b")), "left").drop("__b").select("source", "c2_border", "last")
    c2 = F.floor(F.col("v") * (CELLS * CELLS))
    drawn = F.col("v").isNotNull() & (F.col("c2_border").isNull() | (c2 < F.col("c2_border")) | F.coalesce((c2 == F.col("c2_border")) & (order <= F.col("last")), F.lit(False)))
    out = _with(ranked, written(cut, "mix-cut"), small).withColumn("copies", F.col("whole") + F.when(drawn, 1).otherwise(0))
    return out.select("doc_id", "source", "digest", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("__r")).drop("__r")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with docs' own columns."""
    key, source, digest, copies, turn = fresh(docs.columns, "mix_id", "mix_source", "mix_digest", "mix_copies", "mix_turn")
    chosen = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).groupBy("doc_id", "source", "digest").agg(F.first("copies").alias(copies))
    chosen = chosen.where(F.col(copies) > 0).select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("digest").alias(digest), copies)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    on = docs[id_col].cast("long").eqNullSafe(F.col(key)) & docs[source_col].cast("string").eqNullSafe(F.col(source)) & (F.unhex(F.md5(text.cast("binary"))) == F.col(digest))
    rows = docs.join(chosen, on).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: The whole draw as DuckDB SQL over a table documents(doc_id, text, source): weights 3, 1, 2, share 1.5, cap 2, seed 17.
SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
units AS (SELECT doc_id, source, digest, size, count(*) AS n FROM docs GROUP BY ALL),
src AS (SELECT source, sum(size * n)::HUGEINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM units GROUP BY source),
wt AS (SELECT source, s, CASE (r - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
fill AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(s) OVER lvl, 0) AS full_s, coalesce(sum(w) OVER lvl, 0) AS full_w
  FROM wt WINDOW lvl AS (ORDER BY s::DOUBLE * 2 / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, (3 * total - 4 * full_s) AS lft, 2 * (all_w - full_w) AS room, (3 * total - 4 * full_s) * w <= 4 * s * (all_w - full_w) AS below FROM fill),
lev1 AS (SELECT first(lft ORDER BY s::DOUBLE * 2 / w, source ASC NULLS LAST) AS lft1, first(room ORDER BY s::DOUBLE * 2 / w, source ASC NULLS LAST) AS room1 FROM lev WHERE below),
tgt AS (SELECT source, s, CASE WHEN below THEN w * lft1::DOUBLE / room1::DOUBLE ELSE (2 * s)::DOUBLE END AS target FROM lev CROSS JOIN lev1),
pl AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s::DOUBLE)::BIGINT ELSE 0 END AS whole FROM tgt),
plan AS (SELECT *, target - (whole * s)::DOUBLE AS rest FROM pl),
hist AS (SELECT source, size, sum(n)::HUGEINT AS n FROM units WHERE size > 0 GROUP BY ALL),
sq AS (
  SELECT h.source, size, rest, sum(h.n * size) OVER d - h.n * size AS certain,
         sum(h.n * size * size) OVER (PARTITION BY h.source) - sum(h.n * size * size) OVER d + h.n * size * size AS square
  FROM hist h JOIN plan p ON h.source IS NOT DISTINCT FROM p.source WINDOW d AS (PARTITION BY h.source ORDER BY size DESC)),
lam AS (SELECT source, arg_max(l, size) AS lam FROM (SELECT *, (rest - certain::DOUBLE) / square::DOUBLE AS l FROM sq) WHERE l * size < 1 GROUP BY source),
rnd AS (
  SELECT u.*, p.s, p.target, p.whole, p.rest, least(1.0::DOUBLE, lam * u.size) AS pi,
         (('0x' || substr(md5('17:' || coalesce(u.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS x
  FROM units u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source LEFT JOIN lam l ON u.source IS NOT DISTINCT FROM l.source),
ord AS (SELECT *, CASE WHEN rest > 0 AND size > 0 AND pi > 0 THEN x * (1 - pi) / (x * (1 - pi) + (1 - x) * pi) END AS v FROM rnd),
cum AS (
  SELECT *, CASE WHEN v IS NOT NULL THEN sum(CASE WHEN v IS NOT NULL THEN size * n ELSE 0 END) OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id NULLS FIRST, digest, size ROWS UNBOUNDED PRECEDING) END AS upto FROM ord),
got AS (SELECT *, whole + CASE WHEN v IS NOT NULL AND 2 * (upto - size * n) + size * n <= 2 * rest THEN 1 ELSE 0 END AS copies FROM cum)
"""
RESULT_SQL = SQL + "SELECT doc_id, size::BIGINT AS size, s::BIGINT AS source_size, target, (copies * size)::BIGINT AS taken FROM got, range(got.n)"
