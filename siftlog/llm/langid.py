"""Language identification with unigrams over pieces, summed over all segmentations.

For each language, every piece of a fixed public vocabulary has a probability. The probability of a word is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass over the word's positions adds them up.
The probabilities are learnt by expectation maximisation from the counts of words in labelled texts: a forward and a backward
pass give each piece's expected count. A text's score for a language is the sum over its words, and the published score is
the posterior of the best language. Words are runs of letters, of any length, in lower case.

The fit runs in Spark: each round, tasks add up whole numbers for each piece over the words that they hold, and the driver gets
one row for each piece.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.bpe import KeyMap
from siftlog.llm.chunks import ByteChunks, fresh, held, text_slices
from siftlog.session import dropped, written

#: Letters up to which a word's sums stay in the range of doubles; beyond, the same sums are taken of logarithms.
PLAIN = 32
UNKNOWN = 1e-7
#: Expected counts are added up as whole multiples of 1 / UNIT, so that the order of adding doesn't matter.
UNIT = 1 << 20
_CP = np.uint64(1 << 21)


def usable(path: str):
    """The vocabulary, and the ids of its pieces of text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return sp, [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Pieces:
    """The vocabulary as a trie over code points; edges(words) lists all pieces that match anywhere in the words."""

    def __init__(self, path: str):
        sp, ids = usable(path)
        self.pieces = [sp.id_to_piece(i) for i in ids]
        keys, nodes, piece, index = [], [], [-1], {}
        for k, text in enumerate(self.pieces):
            at = 0
            for c in text:
                nxt = index.get((at, c))
                if nxt is None:
                    nxt = index[at, c] = len(piece)
                    piece.append(-1)
                    keys.append(at << 21 | ord(c))
                    nodes.append(nxt)
                at = nxt
            piece[at] = k
        self.child, self.piece = KeyMap(np.array(keys, np.uint64), np.array(nodes, np.int32)), np.array(piece, np.int32)
        self.unknown = len(self.pieces)  # the piece of a letter that the vocabulary lacks

    def edges(self, words: list[str]):
        """Arrays of (word, start, length, piece), by start, and the words' lengths. Each word begins with the mark of a word's start."""
        text = ["▁" + w for w in words]
        lengths = np.array([len(t) for t in text])
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        cps = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(cps)) - first[word]
        live, node, size = np.arange(len(cps)), np.zeros(len(cps), np.int32), 0
        found, single = [], np.zeros(len(cps), bool)
        room = lengths[word] - start
        while len(live):
            node = self.child.get(node.astype(np.uint64) * _CP + cps[live + size])
            size += 1
            ok = node >= 0
            live, node = live[ok], node[ok]
            hit = self.piece[node] >= 0
            found.append((live[hit], np.full(int(hit.sum()), size), self.piece[node[hit]]))
            if size == 1:
                single[live[hit]] = True
            ok = room[live] > size
            live, node = live[ok], node[ok]
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), int), np.full(len(lone), self.unknown)))
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start[at], kind="stable")
        return word[at[order]], start[at[order]], size[order], piece[order], lengths


def _walk(edges, p: np.ndarray, backward: bool = False):
    """Sums over segmentations up to (or from) each position of each word; rows are positions, columns languages."""
    word, start, size, piece, lengths = edges
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    sums = np.zeros((int((lengths + 1).sum()), p.shape[1]))
    src, dst = first[word] + start, first[word] + start + size
    cuts = np.searchsorted(start, np.arange(int(lengths.max()) + 1))
    steps = list(zip(cuts[:-1], cuts[1:]))
    if not backward:
        sums[first] = 1
        for a, b in steps:  # edges from the same position of a word end at different ones: no two of a step meet
            sums[dst[a:b]] += sums[src[a:b]] * p[piece[a:b]]
    else:
        sums[first + lengths] = 1
        for a, b in reversed(steps):
            np.add.at(sums, src[a:b], sums[dst[a:b]] * p[piece[a:b]])
    return sums, src, dst, first


def _walk_logs(edges, logs: np.ndarray, backward: bool = False):
    """The same of logarithms, for words whose probabilities are too small for doubles."""
    word, start, size, piece, lengths = edges
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    sums = np.full((int((lengths + 1).sum()), logs.shape[1]), -np.inf)
    src, dst = first[word] + start, first[word] + start + size
    cuts = np.searchsorted(start, np.arange(int(lengths.max()) + 1))
    steps = list(zip(cuts[:-1], cuts[1:]))
    sums[first + lengths if backward else first] = 0
    for a, b in reversed(steps) if backward else steps:
        if backward:
            np.logaddexp.at(sums, src[a:b], sums[dst[a:b]] + logs[piece[a:b]])
        else:
            sums[dst[a:b]] = np.logaddexp(sums[dst[a:b]], sums[src[a:b]] + logs[piece[a:b]])
    return sums, src, dst, first


def _by_length(words: list[str]) -> list[tuple[bool, np.ndarray]]:
    """(whether sums need logarithms, numbers of the words), without empty parts."""
    long_ = np.array([len(w) > PLAIN for w in words], bool)
    return [(kind, at) for kind in (False, True) if len(at := np.flatnonzero(long_ == kind))]


def word_scores(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), a row for each word."""
    out = np.zeros((len(words), p.shape[1]))
    for logs, at in _by_length(words):
        edges = pieces.edges([words[i] for i in at])
        sums, _, _, first = _walk_logs(edges, np.log(p)) if logs else _walk(edges, p)
        ends = sums[first + edges[4]]
        out[at] = ends if logs else np.log(ends)
    return out


def expected(pieces: Pieces, p: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces (rows) in each language (columns), in multiples of 1 / UNIT, from words with their counts."""
    n, k = p.shape
    out = np.zeros((n, k), np.int64)
    for logs, at in _by_length(words):
        edges, c = pieces.edges([words[i] for i in at]), counts[at]
        word, piece = edges[0], edges[3]
        if logs:
            fore, src, dst, first = _walk_logs(edges, np.log(p))
            back, *_ = _walk_logs(edges, np.log(p), backward=True)
            share = np.exp(fore[src] + np.log(p)[piece] + back[dst] - fore[first + edges[4]][word]) * c[word]
        else:
            fore, src, dst, first = _walk(edges, p)
            back, *_ = _walk(edges, p, backward=True)
            share = fore[src] * p[piece] * back[dst] * (c / fore[first + edges[4]])[word]
        share = np.rint(share * UNIT)
        for j in range(k):
            out[:, j] += np.bincount(piece, share[:, j], n).astype(np.int64)
    return out


def start(pieces: int, languages: int) -> np.ndarray:
    """Equal probabilities for all pieces; the last row is the unknown piece."""
    p = np.full((pieces + 1, languages), 1.0 / (pieces + 1))
    p[pieces] = UNKNOWN
    return p


def renewed(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts. A language's counts are smoothed by all languages' counts together, so that no piece is impossible."""
    counts = counts / UNIT
    counts[-1] = 0
    pooled = counts.sum(axis=1, keepdims=True) + 0.01
    p = counts + pooled / pooled.sum() * 0.01 * counts.sum(axis=0, keepdims=True) + 1e-9
    p /= p.sum(axis=0, keepdims=True)
    p[-1] = UNKNOWN
    return p


def letters(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


def held_out(id_col: Column) -> Column:
    """True where crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(vocabulary: str) -> Pieces:
    return held(("pieces", vocabulary), lambda: Pieces(vocabulary))


def _expect(vocabulary: str, sent):
    """Rows (word, counts): piece, and for each language its expected count; a row for each piece that a task has met."""

    def run(batches):
        pieces, p = _pieces(vocabulary), sent.value
        total = np.zeros(p.shape, np.int64)
        for b in batches:
            counts = np.stack([np.asarray(c, np.float64) for c in b.columns[1:]], axis=1)
            total += expected(pieces, p, b.column(0).to_pylist(), counts)
        met = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(total[met, j]) for j in range(p.shape[1])]], names=["piece", *[f"e{j}" for j in range(p.shape[1])]])

    return run


def learn(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 800, rounds: int = 4):
    """(languages, probabilities) from rows with a language that are not held out.

    The fit uses about sample_docs documents of each language, chosen by a hash of their text and id. Their words are counted
    and, in each round of EM, worked on in Spark; the driver gets a row for each language and for each piece of the vocabulary.
    Without labelled rows there are no languages.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    n = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((0, 0))
    spark = docs.sparkSession
    at = F.pmod(F.xxhash64(F.col(text_col), F.col(id_col)), F.lit(1 << 20))
    share = F.coalesce(*[F.when(F.col(lang_col) == x, F.lit(int((1 << 20) * min(1, sample_docs / n[x])) + 1)) for x in langs])
    sample = known.where(at < share).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for b in batches:
            c = Counter((x, w) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in letters(t))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c]), pa.array([k[1] for k in c]), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{j}") for j, x in enumerate(langs)])
    words = written(counted.repartition(spark.sparkContext.defaultParallelism, "word"), "langid-words")
    kinds = ", ".join(["piece long", *[f"e{j} long" for j in range(len(langs))]])
    p = start(len(usable(vocabulary)[1]), len(langs))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(p)
        got = words.mapInArrow(_expect(vocabulary, sent), kinds).groupBy("piece").agg(*[F.sum(f"e{j}").alias(f"e{j}") for j in range(len(langs))]).toArrow()
        sent.destroy()
        if not got.num_rows:
            break
        counts = np.zeros(p.shape, np.int64)
        counts[got.column(0).to_numpy()] = np.stack([got.column(j + 1).to_numpy() for j in range(len(langs))], axis=1)
        p = renewed(counts)
    dropped(words)
    return langs, p


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def judge(data: np.ndarray, offsets: np.ndarray, cache: ByteChunks, langs: list[str]) -> list[tuple[str, float]]:
    """(language, posterior) of each text."""
    k = len(langs)
    rows, at = cache.rows(data, offsets)
    rows, at = rows.reshape(-1, k + 1), at // (k + 1)
    total, some = np.zeros((len(at) - 1, k + 1)), at[1:] > at[:-1]
    if some.any():
        total[some] = np.add.reduceat(rows, at[:-1][some], axis=0)
    out = []
    for sums in total:
        if not k or sums[k] < 0.5:
            out.append(("und", 0.0))
            continue
        odds = np.exp(sums[:k] - sums[:k].max())
        best = int(odds.argmax())
        out.append((langs[best], float(odds[best] / odds.sum())))
    return out


def chunk_scores(pieces: Pieces, p: np.ndarray):
    """For ByteChunks: each chunk's log probabilities and its number of letters, as bytes."""

    def make(chunks):
        words = [letters(c) for c in chunks]
        where = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        table = np.zeros((len(where), p.shape[1] + 1))
        todo = list(where)
        for a in range(0, len(todo), 20_000):
            table[a : a + 20_000, :-1] = word_scores(pieces, p, todo[a : a + 20_000])
        table[:, -1] = [len(w) for w in todo]
        none = bytes(8 * table.shape[1])
        return [none if not ws else table[where[ws[0]]].tobytes() if len(ws) == 1 else table[[where[w] for w in ws]].sum(axis=0).tobytes() for ws in words]

    return make


def worker_cache(vocabulary: str, p: np.ndarray) -> ByteChunks:
    """A Python worker keeps one, for the model that it used last, from task to task."""
    return held(("langid", vocabulary, hashlib.sha256(p.tobytes()).digest()), lambda: ByteChunks(chunk_scores(Pieces(vocabulary), p), "<f8", size=400_000))


def identify(docs: DataFrame, vocabulary: str, model=None, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 800) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score.

    Predictions see the text alone. Null text, text without a letter, or a model without languages: lang_pred 'und', score 0.
    Equal scores go to the first language in order. A null id is not held out. Other columns are not read.
    """
    spark = docs.sparkSession
    langs, p = model or learn(docs, vocabulary, lang_col, text_col, id_col, sample_docs)
    if not langs:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast((langs, p))  # pieces x languages x 8 bytes

    def run(batches):
        langs, p = sent.value
        cache = worker_cache(vocabulary, p)
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(2)):
                found = judge(data, offsets, cache, langs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([r[0] for r in found]), pa.array([r[1] for r in found], pa.float64())], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, vocabulary: str, least: float = 0.5, accept: list[str] | None = None, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with their own columns, whose language is recognised with at least this posterior, and accepted. Without labelled rows none is recognised."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    spark = docs.sparkSession
    langs, p = learn(docs, vocabulary, text_col=text_col, **how)
    if not langs:
        return docs.limit(0)
    sent = spark.sparkContext.broadcast((langs, p))
    (mark,) = fresh(docs.columns, "langid_keep")
    where = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(mark, BooleanType())])

    def run(batches):
        langs, p = sent.value
        cache = worker_cache(vocabulary, p)
        for b in batches:
            keep = []
            for _, _, data, offsets in text_slices(pc.fill_null(b.column(where), "")):
                keep += [x != "und" and s >= least and (accept is None or x in accept) for x, s in judge(data, offsets, cache, langs)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keep, pa.bool_())], names=[*b.schema.names, mark])

    return docs.mapInArrow(run, schema).where(F.col(mark)).drop(mark)
