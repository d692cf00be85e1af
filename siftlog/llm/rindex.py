"""Exact substring deduplication with a run-length index.

A string of L bytes is a duplicate where it also starts earlier: in a document before, or earlier in the same one. All bytes
that a duplicate covers go. Judged by 100-byte windows, all of them, on the input as it was.

1. Routing. Of the K-grams in a window the one with the least hash, leftmost on ties, is the window's anchor: it depends on the
   window's bytes alone, so equal windows have equal anchors. Consecutive windows with one anchor form a passage of less than
   2 L bytes. A window whose anchor occurs once in the corpus can't repeat: only anchors that occur twice go on, and all
   places of an anchor take the route of the first document that has it. Passages that touch and go one way form a piece.
2. Pieces with equal bytes are combined, with their first place and number, before they are dealt out, so what a third of all
   documents share arrives once. A route with too many bytes is dealt out anchor by anchor, and an anchor with very many
   different passages window by window; the outcome is the same.
3. Index. Over a batch of pieces: suffix array, Burrows-Wheeler transform kept as its runs, text positions sampled at both
   ends of every run. Pieces are streamed through it from right to left; the matching statistics give for each position the
   longest match and its row, and rows of one block (neighbours with L bytes in common) hold the same window. The first place
   in a block stays, every other window of it is marked.
4. Marks are gathered for each document, and the remaining bytes put together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import mix, release, text_slices
from siftlog.session import dropped, written

L, K = 100, 32
_MUL = np.uint64(0x9FB21C651E98DF25)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))
_HALF = np.uint64(32)
#: Bytes of pieces that one index is built over, but for a route with more; sized for a core's cache.
BATCH = 1 << 19
#: Passages of a piece at most: pieces are streamed side by side, so a long one would hold up the rest.
MOST = 16
#: Bytes of passages of one route beyond which it is dealt out anchor by anchor.
CROWD = 1 << 20
#: Different passages of one anchor beyond which they are dealt out by single windows.
HOT = 4_000


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    return np.cumprod(out)


def passages(data: np.ndarray, offsets: np.ndarray, length: int = L, k: int = K):
    """(text, start in text, bytes, anchor's hash) of the passages of the texts that offsets cut data into."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    up = powers(_MUL, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = mix((sums[k:] - sums[:-k]) * powers(_INV, n - k))
    # Half a hash above, position below: the minimum is the leftmost of the least. As many bits whatever the texts' size, so that
    # equal windows have the same anchor in every slice; a slice is under 2 GiB.
    least = (gram >> _HALF << _HALF) | np.arange(len(gram), dtype=np.uint64)
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    anchor = (least & ((np.uint64(1) << _HALF) - np.uint64(1))).astype(np.int64)
    base = offsets - offsets[0]
    sizes = np.diff(base)
    # A window starts at each place that has `length` bytes of its own text ahead.
    inside = np.zeros(n + 1, np.int64)
    long_ = sizes >= length
    np.add.at(inside, base[:-1][long_], 1)
    np.add.at(inside, base[1:][long_] - length + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    end = np.flatnonzero(last)
    text = np.searchsorted(base, first, "right") - 1
    return text, first - base[text], end - first + length, gram[anchor[first]]


class RunIndex:
    """Run-length index over texts, each with an end mark of its own that sorts before all bytes, marks in the order of the texts."""

    def __init__(self, texts: list[bytes], least: int = L):
        if least < 7:
            raise ValueError("windows of at least 7 bytes")
        self.sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        self.first, self.n = ends - self.sizes, int(ends[-1]) + 1 if len(texts) else 0
        self.symbols = np.zeros(self.n + 1, np.uint16)
        if texts:
            inner = np.ones(self.n, bool)
            inner[ends] = False
            self.symbols[:-1][inner] = np.frombuffer(b"".join(texts), np.uint8)
            self.symbols[:-1][inner] += 1
        self.left = np.repeat(ends, self.sizes + 1) - np.arange(self.n)  # symbols before the text's end mark
        self.least = least
        suffixes = self._sort()
        self._runs(suffixes)

    def _sort(self) -> np.ndarray:
        """The suffix array, by doubling; only suffixes that are still tied are sorted again."""
        n, text = self.n, np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        key = np.zeros(n, np.int64)
        for d in range(7):
            key <<= 9
            m = max(0, n - d)
            key[:m] |= np.where(self.left[:m] >= d, self.symbols[d : d + m], 0).astype(np.int64)
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        del key, ranked
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        tied = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
        todo, depth = order[tied], 7
        bits = int(n + len(self.sizes)).bit_length()
        step = 3 if 3 * bits <= 63 else 2  # ranks that fit into one sorting key
        self.depth, self.same = 0, None
        while True:
            if depth <= self.least:
                # Windows are equal if stretches of length depth that cover them are: ranks at this depth name those.
                self.depth, self.same = depth, rank.copy()
            if not len(todo):
                break
            second, left = [], self.left[todo]
            for k in range(1, step):
                # Where a text has ended its number decides, once; what follows that doesn't matter.
                later = len(self.sizes) + rank[np.minimum(todo + k * depth, n - 1)]
                second.append(np.where(left < k * depth, np.where(left < (k - 1) * depth, 0, text[todo]), later))
            key = rank[todo]
            for x in second:
                key = key << bits | x
            by = np.argsort(key)
            todo, key = todo[by], key[by]
            group = rank[todo]
            at = np.arange(len(todo))
            head = np.ones(len(todo), bool)
            head[1:] = group[1:] != group[:-1]
            sub = np.ones(len(todo), bool)
            sub[1:] = key[1:] != key[:-1]
            base = np.maximum.accumulate(np.where(head, at, 0))
            order[group + at - base] = todo
            rank[todo] = group + np.maximum.accumulate(np.where(sub, at, 0)) - base
            alone = sub & np.append(sub[1:], True)
            todo, depth = todo[~alone], step * depth
        return order

    def _runs(self, suffixes: np.ndarray) -> None:
        bwt = self.symbols[suffixes - 1]
        bwt[np.isin(suffixes, self.first)] = 0  # before a text's start stands an end mark
        new = np.ones(self.n, bool)
        new[1:] = bwt[1:] != bwt[:-1]
        self.run = np.flatnonzero(new)
        self.symbol = bwt[self.run].astype(np.int64)
        size = np.diff(np.append(self.run, self.n))
        by_symbol = np.argsort(self.symbol, kind="stable")
        count = np.bincount(self.symbols[: self.n], minlength=258)
        below = np.cumsum(count) - count
        into = np.cumsum(size[by_symbol]) - size[by_symbol]
        first_of = np.searchsorted(self.symbol[by_symbol], self.symbol[by_symbol])
        self.lf = np.empty(len(self.run), np.int64)
        self.lf[by_symbol] = below[self.symbol[by_symbol]] + into - into[first_of]
        self.keys = self.symbol[by_symbol] * len(self.run) + by_symbol  # sorted: runs of each symbol
        self.head, self.tail = suffixes[self.run], suffixes[self.run + size - 1]  # sampled run ends
        self.size = size
        # Blocks: neighbours that agree in the first `least` symbols.
        block = np.ones(self.n, bool)
        long_ = self.left[suffixes] >= self.least
        equal = long_[1:] & long_[:-1]
        for shift in sorted({*range(0, self.least - self.depth, self.depth), self.least - self.depth}):
            name = self.same[np.minimum(suffixes + shift, self.n - 1)]
            equal &= name[1:] == name[:-1]
        block[1:] = ~equal
        # Directories from rows to runs and blocks, in place of a binary search for each step.
        self.run_of = np.repeat(np.arange(len(self.run), dtype=np.int32), size)
        self.block_of = np.cumsum(block, dtype=np.int32) - 1
        self.same = None

    def _common(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes x and y, up to limit."""
        out, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            live = live[out[live] < np.minimum(limit[live], np.minimum(self.left[x[live]], self.left[y[live]]))]
            live = live[self.symbols[x[live] + out[live]] == self.symbols[y[live] + out[live]]]
            out[live] += 1
        return out

    def stream(self, symbols: np.ndarray, row: np.ndarray, place: np.ndarray, match: np.ndarray):
        """One step to the left for many patterns at a time: their next symbols (1 to 256), with the row of the match so far, its text position and its length."""
        run = self.run_of[row]
        bad = np.flatnonzero(self.symbol[run] != symbols)
        if len(bad):
            # Jump to the nearest run of the symbol above or below, whichever agrees with the match further.
            at = np.searchsorted(self.keys, symbols[bad] * len(self.run) + run[bad])
            best, best_run, best_row, best_place = np.full(len(bad), -1), run[bad].astype(np.int64), row[bad].copy(), place[bad].copy()
            for step, ends, top in ((-1, self.tail, False), (0, self.head, True)):
                k = np.clip(at + step, 0, len(self.keys) - 1)
                there = self.keys[k] % len(self.run)
                ok = (self.keys[k] // len(self.run) == symbols[bad]) & ((at + step >= 0) & (at + step < len(self.keys)))
                got = np.where(ok, self._common(place[bad], ends[there], match[bad]), -1)
                take = got > best
                best[take], best_run[take], best_place[take] = got[take], there[take], ends[there[take]]
                best_row[take] = self.run[there[take]] + (0 if top else self.size[there[take]] - 1)
            row, place, match = row.copy(), place.copy(), match.copy()
            run[bad], row[bad], place[bad], match[bad] = best_run, best_row, best_place, best
        found = match >= 0
        row = np.where(found, self.lf[run] + row - self.run[run], 0)
        return row, np.where(found, place - 1, self.sizes[0]), match + 1

    def statistics(self, patterns: list[bytes], own: bool = False):
        """For each pattern, right to left in lockstep: yields (patterns at work, position in them, row, length of the longest match that starts there).

        own: the patterns are the index's texts, in order, end marks included; the match then starts at a text's own mark.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        flat = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        row = np.arange(len(patterns)) if own else np.zeros(len(patterns), np.int64)
        place = self.first + self.sizes if own else np.full(len(patterns), self.sizes[0])  # row 0 is the first text's end mark
        match = np.zeros(len(patterns), np.int64)
        longest_first = np.argsort(-sizes, kind="stable")
        down = -sizes[longest_first]
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = longest_first[: np.searchsorted(down, -step, "right")]
            row[live], place[live], match[live] = self.stream(flat[ends[live] - step], row[live], place[live], match[live])
            yield live, sizes[live] - step, row[live], match[live]


def repeated_windows(texts: list[bytes], keys: np.ndarray, length: int = L):
    """For texts with the place of their first byte (keys, comparable numbers): (text, start) of the windows that also start at a lesser place."""
    index = RunIndex(texts, length)
    blocks, texts_, starts = [], [], []
    for live, at, row, match in index.statistics(texts, own=True):
        ok = match >= length
        blocks.append(index.block_of[row[ok]])
        texts_.append(live[ok])
        starts.append(at[ok])
    block, text, start = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (blocks, texts_, starts))
    place = keys[text] + start
    least = np.full(int(index.block_of[-1]) + 1 if index.n else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, block, place)
    marked = place > least[block]
    return text[marked], start[marked]


def runs_of(text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes (text, from, to) that windows cover; touching runs are one."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + length)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(text)) - 1
    return text[head], start[head], start[tail] + length if len(head) else start


def _anchors(length: int, k: int, full: bool):
    names = ["anchor", "ord", "sub", "at"] if full else ["anchor", "ord"]

    def run(batches):
        release()
        for b in batches:
            for i, _, data, offsets in text_slices(b.column(2)):
                text, start, size, gram = passages(data, offsets, length, k)
                rows = pa.array(text + i)
                columns = [pa.array(gram.view(np.int64)), b.column(0).take(rows)]
                if full:
                    columns += [b.column(1).take(rows), pa.array(start << 8 | size)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_CUT = "route long, whole boolean, content_key binary, ord long, sub long, start long, size int, content binary"


def _cut(length: int):
    """Rows (ord, sub, text, places): a row for each piece; its bytes come with the first of equal ones that a batch holds.

    A piece is a run of passages that touch and go to one route. It ends after an anchor whose hash says so, one in eight, so
    equal stretches of text are cut alike wherever they stand, and after MOST passages.
    """

    def run(batches):
        release()
        for b in batches:
            found = b.column(3)
            flat = found.flatten()
            anchor, route, at, crowded = (np.asarray(flat.field(i)) for i in range(4))
            row = np.repeat(np.arange(len(found)), np.asarray(found.value_lengths()))
            start, size = at >> 8, at & 255
            order = np.lexsort((start, row))
            row, start, size, anchor, route, crowded = (x[order] for x in (row, start, size, anchor, route, crowded))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + size[:-1] - length + 1) | crowded[1:] | crowded[:-1] | (route[1:] != route[:-1]) | ((anchor[:-1] >> 7) & 7 == 0)
            place = np.arange(len(row))
            new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST == 0
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(row)) - 1
            ends = start[tail] + size[tail]
            routes = np.where(crowded[head], anchor[head], route[head])
            ords, subs = (np.asarray(b.column(i)) for i in (0, 1))
            for i in range(0, len(head), 20_000):
                h = slice(i, i + 20_000)
                rows, first, last = row[head[h]], start[head[h]], ends[h]
                keys, contents, seen, text, known = [], [], set(), b"", -1
                for r, x, y in zip(rows.tolist(), first.tolist(), last.tolist()):
                    if r != known:
                        text, known = b.column(2)[r].as_py(), r
                    content = text[x:y]
                    key = hashlib.blake2b(content, digest_size=16).digest()
                    keys.append(key)
                    contents.append(None if key in seen else content)
                    seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(routes[h]), pa.array(~crowded[head[h]]), pa.array(keys, pa.binary()), pa.array(ords[rows]), pa.array(subs[rows]), pa.array(first), pa.array((last - first).astype(np.int32)), pa.array(contents, pa.binary())],
                    names=["route", "whole", "content_key", "ord", "sub", "start", "size", "content"],
                )

    return run


def _index(length: int, batch_bytes: int):
    """Rows (whole, route, content, ord, sub, start), by route: marked bytes (ord, sub, from, to) of the pieces' first places."""
    names = ["ord", "sub", "from", "to"]

    def work(rows):
        _, document = np.unique(np.array([(r[3], r[4]) for r in rows], dtype=[("o", np.int64), ("s", np.int64)]), return_inverse=True)
        start = np.array([r[5] for r in rows], np.int64)
        text, at = repeated_windows([r[2] for r in rows], document.reshape(-1) << 32 | start, length)
        text, a, b = runs_of(text, at, length)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][3] for i in text], pa.int64()), pa.array([rows[i][4] for i in text], pa.int64()), pa.array(start[text] + a), pa.array(start[text] + b)], names=names)

    def run(batches):
        release()
        rows, size = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= batch_bytes and r[:2] != rows[-1][:2]:
                    yield work(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield work(rows)

    return run


def _finish(batches):
    names = ["row", "n_bytes", "n_removed", "n_spans", "kept"]
    for b in batches:
        out = []
        for row, text, found in zip(*(c.to_pylist() for c in b.columns)):
            spans = []
            for x in sorted((m["from"], m["to"]) for m in found or []):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append([*x])
            parts, at = [], 0
            for a, e in spans:
                parts.append(text[at:a])
                at = e
            parts.append(text[at:])
            out.append((row, len(text), sum(e - a for a, e in spans), len(spans), b"".join(parts)))
        kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)


def remove_repeats(docs: DataFrame, length: int = L, k: int = K, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH, crowd_bytes: int = CROWD, hot: int = HOT) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty; texts shorter than length lose nothing. Documents are in the order of their ids, null
    first; rows that share an id follow one another by a hash of their text, and rows that repeat id and text count as one
    document. What remains may cut a character in two, so it is binary. length is at most 127: a passage has under 255 bytes.
    """
    if not max(k, 7) <= length <= 127:
        raise ValueError("length must be between max(k, 7) and 127")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    ids = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ids, F.lit(-(1 << 63))).alias("ord"), F.xxhash64(data).alias("sub"), data.alias("data"), ids.alias("doc_id"))
    if docs.groupBy(ids).count().where("count > 1").isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("long"))  # ids alone tell rows apart
    texts = rows.select("ord", "sub", "data")
    known = texts.mapInArrow(_anchors(length, k, False), "anchor long, ord long").groupBy("anchor").agg(F.count("*").alias("n"), F.min("ord").alias("route")).where("n > 1").select(F.col("anchor").alias("twice"), "route")
    known = kept = written(known, "rindex-anchors")  # by itself, so that the join can deal a common anchor to several tasks
    places = texts.mapInArrow(_anchors(length, k, True), "anchor long, ord long, sub long, at long")
    held = places = written(places.join(known.hint("shuffle_hash"), F.col("anchor") == F.col("twice")).select("anchor", "route", "ord", "sub", "at"), "rindex-places")
    dropped(kept)
    load = places.groupBy("route").agg(F.sum(F.col("at").bitwiseAND(F.lit(255))).alias("bytes")).where(F.col("bytes") > crowd_bytes).select(F.col("route").alias("r"))
    places = places.join(load, F.col("route") == F.col("r"), "left").select("ord", "sub", F.struct("anchor", "route", "at", F.col("r").isNotNull().alias("crowded")).alias("x"))
    of_text = places.groupBy(F.col("ord").alias("o"), F.col("sub").alias("s")).agg(F.collect_set("x").alias("found"))  # less than one for each byte of a text
    cut = texts.join(of_text, (F.col("ord") == F.col("o")) & (F.col("sub") == F.col("s"))).select("ord", "sub", "data", "found")
    cut = written(cut.mapInArrow(_cut(length), _CUT), "rindex-pieces")
    dropped(held)

    place = F.struct("ord", "sub", "start")
    strings = written(cut.groupBy("whole", "route", "content_key").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("content").alias("content")), "rindex-strings")
    # An anchor of a crowded route with very many different passages.
    full = strings.where("not whole").groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(F.col("route").alias("c"), F.lit(False).alias("c_whole"))
    on = (F.col("route") == F.col("c")) & (F.col("whole") == F.col("c_whole"))
    plain = strings.join(full, on, "left_anti").select("whole", "route", "content", "first.ord", "first.sub", "first.start")
    j = F.explode(F.sequence(F.lit(0), F.length("content") - length))
    windows = strings.join(full, on, "left_semi").select("content", "first", j.alias("j"))
    windows = windows.select(F.expr(f"substring(content, j + 1, {length})").alias("content"), "first.ord", "first.sub", (F.col("first.start") + F.col("j")).alias("start"))
    routed = plain.repartition("whole", "route").sortWithinPartitions("whole", "route").mapInArrow(_index(length, batch_bytes), "ord long, sub long, from long, to long")
    single = _single_windows(windows)
    # A piece that isn't the first of its bytes repeats whole.
    firsts = strings.where("n > 1").select(F.col("whole").alias("w"), F.col("route").alias("a"), F.col("content_key").alias("ck"), "first")
    later = cut.join(firsts, (F.col("whole") == F.col("w")) & (F.col("route") == F.col("a")) & (F.col("content_key") == F.col("ck"))).where(place != F.col("first"))
    later = later.select("ord", "sub", F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))
    single = single.select("ord", "sub", F.col("start").alias("from"), (F.col("start") + length).alias("to"))
    marks = written(routed.unionByName(single).unionByName(later), "rindex-marks")
    dropped(cut, strings)
    spans = marks.groupBy(F.col("ord").alias("o"), F.col("sub").alias("s")).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = rows.join(spans, (F.col("ord") == F.col("o")) & (F.col("sub") == F.col("s")), "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(_finish, "row long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("row", "doc_id")


def _single_windows(windows: DataFrame) -> DataFrame:
    """Of windows that are dealt out one by one all but the first of equal ones."""
    place = F.struct("ord", "sub", "start")
    first = windows.groupBy(F.col("content").alias("c")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, F.col("content") == F.col("c")).where(place != F.col("first")).select("ord", "sub", "start")
