"""What the tokenizing operators share: a text is cut at spaces and line feeds, and each distinct chunk is worked on once."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Distinct chunks that a worker remembers; when there are more it forgets those not in use and goes on. Bounds memory, not results.
CACHE = 250_000


_held: dict = {}


def held(key, make: Callable):
    """What make() gives; a Python worker keeps the one thing that it used last, from task to task."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what the operators that ran before in this worker have kept."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh(columns, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


class ChunkCache:
    """A dictionary of chunks' values that make(list of new chunks) works out. Operators keep one for each Python worker, from task to task."""

    def __init__(self, make: Callable[[list[str]], list], size: int = CACHE):
        self.make, self.size, self.known = make, size, {}

    def lookup(self, wanted: set[str]) -> dict:
        """A dictionary that has at least the wanted chunks."""
        todo = sorted(wanted.difference(self.known))
        if len(self.known) + len(todo) > self.size:
            self.known = {c: self.known[c] for c in wanted.intersection(self.known)}
        if todo:
            self.known.update(zip(todo, self.make(todo)))
        return self.known


def text_slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, offsets) over runs of rows of about limit bytes of a text column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., count of them, for each pair, on end."""
    upto = np.cumsum(count)
    return np.repeat(start - (upto - count), count) + np.arange(upto[-1] if len(upto) else 0)


def spans(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, of each text its first span's number and the end) of the runs of bytes that cut (by byte) leaves of the texts that offsets cut data into."""
    base = offsets - offsets[0]
    inside = ~cut[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = base[1:-1][(base[1:-1] > 0) & (base[1:-1] < len(data))]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1 - start, np.searchsorted(start, base)


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes beyond which a span is hashed and compared by itself.
LONG = 256


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data on, as an integer; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time through a mixing function, all spans in lockstep; BLAKE2b for long ones.

    Each step is a bijection of what it adds, so spans of equal size up to eight bytes never share a hash.
    """
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view, live, at = eights(data), np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        out[live] = mix(out[live] * np.uint64(0x9FB21C651E98DF25) + (view[start[live] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return out


_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True


class ByteChunks:
    """Each chunk of the texts' bytes becomes a row of small integers, worked out once, and a text the rows of its chunks on end.

    A chunk is looked up by a 64-bit hash of its bytes and then compared with the bytes that the table has: one that shares
    another's hash is worked out by itself. The table keeps up to `size` chunks and `most` bytes of them and of their rows; when
    it is full, those go that were met least often, counting each call once.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], kind: str, size: int = 600_000, most: int = 96 << 20):
        self.make, self.kind, self.size, self.most = make, np.dtype(kind), size, most
        self.keys, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        self.at, self.bytes, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _prune(self) -> None:
        least, weight = 2, self.bytes + self.count * self.kind.itemsize
        keep = self.hits >= least
        while keep.sum() > self.size // 2 or weight[keep].sum() > self.most // 2:
            least *= 2
            keep = self.hits >= least
        keep = np.flatnonzero(keep)
        self.pool, self.text = self.pool[stretches(self.start[keep], self.count[keep])], self.text[stretches(self.at[keep], self.bytes[keep])]
        self.keys, self.count, self.bytes, self.hits = (x[keep] for x in (self.keys, self.count, self.bytes, self.hits))
        self.start, self.at = np.cumsum(self.count) - self.count, np.cumsum(self.bytes) - self.bytes

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(integers of all texts on end, where each text's integers begin and the last ends) for texts that offsets cut data (UTF-8) into."""
        none = np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        if not len(data):
            return none
        first, sizes, of_text = spans(data, offsets, _CUT)
        if not len(first):
            return none
        keys, where, inverse = np.unique(span_hashes(data, first, sizes), return_index=True, return_inverse=True)
        entry = self._entries(keys, data, first[where], sizes[where])
        self.hits[entry] += 1
        entry = entry[inverse]
        start, count, pool = self.start[entry], self.count[entry], self.pool
        odd = np.flatnonzero(~self._same(entry, data, first, sizes))
        if len(odd):
            values = self._made(data, first[odd], sizes[odd])
            count[odd] = [len(v) // self.kind.itemsize for v in values]
            start[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate([pool, np.frombuffer(b"".join(values), self.kind)])
        upto = np.concatenate([[0], np.cumsum(count)])
        return pool[stretches(start, count)], upto[of_text]

    def _made(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        raw = data.tobytes()
        return self.make([raw[i : i + n].decode() for i, n in zip(start.tolist(), size.tolist())])

    def _same(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes that its entry has."""
        same = self.bytes[entry] == size
        own, kept, live, at = eights(data), eights(self.text), np.flatnonzero(same & (size <= LONG)), 0
        while len(live):
            left = size[live] - at
            same[live] = (own[start[live] + at] ^ kept[self.at[entry[live]] + at]) & _KEEP[np.minimum(left, 8)] == 0
            at += 8
            live = live[(left > 8) & same[live]]
        for i in np.flatnonzero(same & (size > LONG)).tolist():
            a, n = self.at[entry[i]], size[i]
            same[i] = np.array_equal(self.text[a : a + n], data[start[i] : start[i] + n])
        return same

    def _entries(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the distinct sorted keys stand in the table; those it lacks are worked out and put in."""
        if len(self.keys) + len(keys) > self.size or len(self.text) + self.pool.nbytes > self.most:
            self._prune()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            values = self._made(data, start[new], size[new])
            sizes = np.array([len(v) for v in values], np.int64) // self.kind.itemsize
            starts, places = len(self.pool) + np.cumsum(sizes) - sizes, len(self.text) + np.cumsum(size[new]) - size[new]
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(values), self.kind)])
            self.text = np.concatenate([self.text, data[stretches(start[new], size[new])]])
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            more = ((self.keys, keys[new]), (self.start, starts), (self.count, sizes), (self.at, places), (self.bytes, size[new]), (self.hits, np.zeros(len(new), np.int32)))
            self.keys, self.start, self.count, self.at, self.bytes, self.hits = (np.concatenate(x)[order] for x in more)
            at = np.searchsorted(self.keys, keys)
        return at
