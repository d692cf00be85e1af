"""Near-duplicate detection on word shingles with SetSketch registers.

A sketch has M registers. Register i is the maximum over a set's elements of floor(1 - log_b(x)), x exponential with rate A and
drawn from a hash of element and i: minima on an exponential scale, truncated to two bytes. Maxima of two sketches are the
sketch of the union, and two registers agree with a probability that rises with the Jaccard similarity J (about J for J near
1). Bands of R registers are the candidate keys: with 18 bands of 4, a pair at J = 0.8 shares none with probability 4e-5.

Documents with equal sets are one node from the start. Within a band's bucket every node is compared with the bucket's least
node, on full sets. Where a bucket then still holds several components, its pairs across components are estimated, jointly by
likelihood from registers greater, less and equal, and compared on full sets in that order, block by block, inside a task; what
is linked already isn't compared. So no link between different texts that share a band is lost, no pairs are emitted but
verified links, and no bucket is gathered in one task. Sets too small to be linked with any other are left out beforehand.

A set's elements are 64-bit hashes of its shingles, through a mixing function that leaves no structure to collide on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import fresh, mix, release, span_hashes, spans, text_slices
from siftlog.llm.components import components
from siftlog.session import written

R, BANDS = 4, 18
M = R * BANDS
#: Two bytes for a register, as fine as they allow: registers of unlike sets agree with probability 0.0005, not the 0.09 of
#: byte-sized ones, so a band of 4 brings together texts that are alike, whatever the number of documents.
BASE, A, TOP = 1.001, 20.0, (1 << 16) - 1
#: Nodes in a block of a bucket that is compared as a whole.
BLOCK = 512

_rng = np.random.Generator(np.random.PCG64(20210707))
_XOR = _rng.integers(0, 1 << 63, M, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.uint64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that offsets cut data (UTF-8) into, and each text's number of words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    start, size, of_text = spans(data, offsets, _SPACE)
    return span_hashes(_LOWER[data], start, size), np.diff(of_text)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its set: sorted distinct hashes of its runs of k words, or of all its words where they are fewer."""
    words, counts = word_hashes(data, offsets)
    runs = words.copy()
    for j in range(1, k):
        m = max(len(words) - j, 0)
        runs[:m] = mix(runs[:m] * _POW + words[j : j + m])
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            whole = np.array([n], np.uint64)
            for w in words[at : at + n]:
                whole = mix(whole * _POW + w)
            yield whole
        else:
            yield np.zeros(0, np.uint64)
        at += n


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers (uint16) of a set of hashes; zeros for the empty set."""
    if not len(elements):
        return np.zeros(M, np.uint16)
    least = np.full(M, ~np.uint64(0))
    for a in range(0, len(elements), 2048):
        least = np.minimum(least, ((elements[a : a + 2048, None] ^ _XOR) * _MUL).min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely J of each pair (rows of registers, with the sets' sizes), from the registers greater, less and equal."""
    u = (na / (na + nb))[:, None]
    v, j = 1 - u, np.minimum(_GRID[None, :], np.minimum(na / nb, nb / na)[:, None])
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    d_more, d_less = (ka > kb).sum(axis=1, keepdims=True), (ka < kb).sum(axis=1, keepdims=True)
    logs = lambda d, q: np.where(d > 0, d * np.log(np.maximum(q, 1e-12)), 0)
    like = logs(d_more, more) + logs(d_less, less) + logs(M - d_more - d_less, 1 - more - less)
    return j[np.arange(len(j)), like.argmax(axis=1)]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a and b| >= num * |a or b|; a and b are sorted and distinct."""
    if num * max(len(a), len(b)) > den * min(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b]))) if len(a) else 0
    return den * both >= num * (len(a) + len(b) - both)


_NODES = "doc_id long, digest binary, n_shingles long, node binary, sketch binary"
_NODES_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary())])


def _describe(k: int):
    def run(batches):
        release()
        for b in batches:
            ids, digests = b.column(0), b.column(1)
            for i, j, data, offsets in text_slices(b.column(2)):
                sets = list(shingle_sets(data, offsets, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i), digests.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    schema=_NODES_ARROW,
                )

    return run


def _set_rows(k: int):
    schema = pa.schema([("node", pa.binary()), ("elements", pa.binary())])

    def run(batches):
        release()
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(1)):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, k)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sets, pa.binary())], schema=schema)

    return run


_LINKS = "u binary, v binary"
_LINKS_ARROW = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _emit_links(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], schema=_LINKS_ARROW)


def _verify_stars(num: int, den: int):
    """Rows (star, part, node, elements), a part's first row being its star: links between the star and its members."""

    def run(batches):
        star, own = None, None
        for b in batches:
            rows = []
            for key, part, node, elements in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(elements, np.uint64)
                if node is None:
                    star, own = (key, part), s
                elif star == (key, part) and linked(own, s, num, den):
                    rows.append((key, node))
            if rows:
                yield _emit_links(rows)

    return run


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> None:
        self.up[self.find(x)] = self.find(y)


def _groups(batches, width: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal first `width` columns, which the sort has put side by side."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:width] != key:
                if rows:
                    yield key, rows
                key, rows = r[:width], []
            rows.append(r[width:])
    if rows:
        yield key, rows


def _pairs(band: int, i: int, j: int, rows: list, ratio: float, least: float) -> list[tuple[int, int]]:
    """Pairs of rows (block, node, root, n, sketch, ...) in two blocks of a bucket, of different roots, whose first common band this is, the most alike first.

    Left out are pairs whose sizes alone rule a link out, and those with an estimate under least.
    """
    block = np.array([r[0] for r in rows])
    regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, M)
    n = np.array([r[3] for r in rows], np.float64)
    _, root = np.unique(np.array([r[2] for r in rows], dtype=object), return_inverse=True)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = []
    for a in left:
        other = right[right > a] if i == j else right
        other = other[(root[other] != root[a]) & (np.minimum(n[other], n[a]) >= ratio * np.maximum(n[other], n[a]))]
        if not len(other):
            continue
        same = (regs[other] == regs[a]).reshape(len(other), BANDS, R).all(axis=2)
        other = other[same.argmax(axis=1) == band]
        if len(other):
            est = estimate(np.broadcast_to(regs[a], (len(other), M)), regs[other], np.full(len(other), n[a]), n[other])
            found += [(-e, int(a), int(x)) for e, x in zip(est.tolist(), other.tolist()) if e >= least]
    return [x[1:] for x in sorted(found)]


def _candidates(ratio: float, least: float):
    """Rows (band, key, i, j, block, node, root, n, sketch): the same rows less elements, for nodes that have a pair in another component."""

    def run(batches):
        for (band, key, i, j), rows in _groups(batches, 4):
            live = sorted({x for p in _pairs(band, i, j, rows, ratio, least) for x in p})
            if live:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([band] * len(live), pa.int32()), pa.array([key] * len(live), pa.binary()), pa.array([i] * len(live), pa.int32()), pa.array([j] * len(live), pa.int32()),
                        pa.array([rows[x][0] for x in live], pa.int32()), pa.array([rows[x][1] for x in live], pa.binary()), pa.array([rows[x][2] for x in live], pa.binary()),
                        pa.array([rows[x][3] for x in live], pa.int64()), pa.array([rows[x][4] for x in live], pa.binary()),
                    ],
                    names=["band", "key", "i", "j", "block", "node", "root", "n", "sketch"],
                )

    return run


def _verify_blocks(ratio: float, least: float, num: int, den: int):
    def run(batches):
        for (band, _, i, j), rows in _groups(batches, 4):
            sets, forest, links = [np.frombuffer(r[5], np.uint64) for r in rows], _Forest(), []
            for a, b in _pairs(band, i, j, rows, ratio, least):
                ra, rb = forest.find(rows[a][2]), forest.find(rows[b][2])
                if ra != rb and linked(sets[a], sets[b], num, den):
                    forest.join(ra, rb)
                    links.append((rows[a][1], rows[b][1]))
            if links:
                yield _emit_links(links)

    return run


def _buckets(nodes: DataFrame) -> DataFrame:
    """band, key, node for each band of each node; equal (band, key) means equal registers in that band."""
    at = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    return nodes.select("node", "sketch", at.alias("band")).select("band", F.expr(f"substring(sketch, band * {2 * R} + 1, {2 * R})").alias("key"), "node")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", least_estimate: float = 0.0) -> DataFrame:
    """One row for each input row: doc_id, digest (MD5 of the text), n_shingles, component_id, kept, only.

    Sets are distinct runs of k words, words being [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words has one
    run, all of them; null text and text without words have the empty set and are linked with nothing. Two rows are linked if
    |and| / |or| of their sets is at least threshold, as a fraction. component_id is the least id reachable, kept is true where
    it is the row's own. Null ids sort last: a component of null ids alone has none. `only` marks, of kept rows that
    share an id, those with one and the same set. Rows may repeat. Beyond a bucket's least node, pairs whose estimated
    similarity is under least_estimate are not compared: 0 compares all, more saves time and may lose links.
    """
    num, den = threshold
    ratio = num / den
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    described = written(rows.mapInArrow(_describe(k), _NODES), "near-docs")
    classes = written(described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "digest")).alias("one")), "near-classes")

    # Buckets with several nodes, and the least node of each as its star.
    # A set of n has at most n / (n + 1) with any other one.
    buckets = _buckets(classes.where(F.col("n") * den >= num * (F.col("n") + 1)))
    # A table by itself, so that the join back can deal a common bucket to several tasks.
    stars = written(buckets.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("node").alias("star")).where("size > 1"), "near-stars")
    s = stars.select(F.col("band").alias("s_band"), F.col("key").alias("s_key"), "size", "star")
    members = written(buckets.join(s, (F.col("band") == F.col("s_band")) & (F.col("key") == F.col("s_key"))).select("band", "key", "size", "star", "node"), "near-buckets")

    # Full sets, worked out again from the texts of the nodes that share a bucket.
    # One row stands for all that repeat its set.
    involved = classes.join(members.select(F.col("node").alias("m")).distinct(), F.col("node") == F.col("m"), "left_semi").select("node", F.col("one.doc_id").alias("c_id"), F.col("one.digest").alias("c_digest"))
    one_text = rows.join(involved, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("digest") == F.col("c_digest")), "inner").select("node", "text")
    sets = written(one_text.mapInArrow(_set_rows(k), "node binary, elements binary").dropDuplicates(["node"]), "near-sets")
    links = written(_star_links(members, sets, num, den), "near-links")
    links = links.unionByName(written(_rest_links(members, classes, sets, links, ratio, least_estimate, num, den), "near-links"))

    roots = components(links)
    joined = classes.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "min_id", F.coalesce("root", "node").alias("root"))
    first = F.struct(F.col("min_id").isNull(), "min_id", "node")
    heads = joined.groupBy("root").agg(F.min_by("min_id", first).alias("component_id"), F.min_by("node", first).alias("head"))
    decided = joined.join(heads.withColumnRenamed("root", "h_root"), F.col("root") == F.col("h_root")).select(F.col("node").alias("d_node"), "component_id", "head")
    out = described.join(decided, F.col("node") == F.col("d_node"), "left")
    in_set = F.col("n_shingles") > 0
    component = F.when(in_set, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), (~in_set | (F.col("node") == F.col("head"))).alias("only"))


def _star_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links between each bucket's star and its members. A star with many members is dealt to parts of 256."""
    pairs = members.where("node <> star").select("star", "node").distinct()
    many = pairs.groupBy("star").agg(F.ceil(F.count("*") / 256).alias("parts")).withColumnRenamed("star", "p_star")
    pairs = written(pairs.join(many, F.col("star") == F.col("p_star")).select("star", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "node"), "near-pairs")
    of_member = pairs.join(sets.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("star", "part", "node", "elements")
    of_star = pairs.select("star", "part").distinct().join(sets.withColumnRenamed("node", "n"), F.col("star") == F.col("n")).select("star", "part", F.lit(None).cast("binary").alias("node"), "elements")
    both = of_member.unionByName(of_star).repartition("star", "part").sortWithinPartitions("star", "part", F.col("node").asc_nulls_first())
    return both.mapInArrow(_verify_stars(num, den), _LINKS)


def _rest_links(members: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, ratio: float, least: float, num: int, den: int) -> DataFrame:
    """Verified links within buckets that hold several components after the stars."""
    roots = components(links)
    m = members.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("band", "key", "size", "node", F.coalesce("root", "node").alias("root"))
    mixed = written(m.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("band").alias("x_band"), F.col("key").alias("x_key")), "near-mixed")
    rows = m.join(mixed, (F.col("band") == F.col("x_band")) & (F.col("key") == F.col("x_key"))).drop("x_band", "x_key")
    rows = rows.join(classes.select(F.col("node").alias("c"), "n", "sketch"), F.col("node") == F.col("c")).drop("c")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    # Each block meets each: a node goes to the tasks (i, j), i <= j, that its block is one of.
    meet = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = rows.withColumn("t", F.explode(meet)).select("band", "key", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "block", "node", "root", "n", "sketch")
    order = ["band", "key", "i", "j"]
    kinds = "band int, key binary, i int, j int, block int, node binary, root binary, n long, sketch binary"
    live = written(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_candidates(ratio, least), kinds), "near-live")
    full = live.join(sets.withColumnRenamed("node", "n_node"), F.col("node") == F.col("n_node")).select(*live.columns, "elements")
    return full.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(_verify_blocks(ratio, least, num, den), _LINKS)


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, less near duplicates: of each component the row with the least id stays, once."""
    found = near_duplicates(docs, k, threshold, id_col, text_col)
    key, digest, rows = fresh(docs.columns, "near_id", "near_digest", "near_rows")
    stays = found.where("kept and only").groupBy(F.col("doc_id").alias(key), F.col("digest").alias(digest)).agg(F.count("*").alias(rows))
    on = docs[id_col].cast("long").eqNullSafe(F.col(key)) & (F.unhex(F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))) == F.col(digest))
    joined = docs.join(stays, on)
    once = joined.where(F.col(rows) == 1).unionByName(joined.where(F.col(rows) > 1).dropDuplicates([key, digest]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
