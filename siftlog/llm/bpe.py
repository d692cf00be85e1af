"""Exact BPE by dynamic programming over prefixes.

For every prefix of a word, the encoding of that prefix ends in one token; it is the only token that matches at the prefix's
end, and whose pair with the last token of the prefix before it is *compatible*: encoding the two tokens' text again gives
just these two. So one pass over a word, which finds the matches with a suffix automaton of the vocabulary and tests pairs,
stores the unique last token of every prefix, and following these back from the end gives the exact ids. Merges are never
replayed on a text.

Words are independent, so a batch of distinct words is worked on in lockstep, one numpy operation for all words at a time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import ByteChunks, held, text_slices

_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyMap:
    """From uint64 keys to int32 values (-1: absent): open addressing in numpy, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.values[at] < 0
            first = np.unique(np.where(free, at, -1), return_index=True)
            take = first[1][first[0] >= 0]
            self.keys[at[take]], self.values[at[take]] = keys[todo[take]], values[todo[take]]
            left = np.ones(len(todo), bool)
            left[take] = False
            todo, at = todo[left], at[left]
            at = np.where(self.values[at] >= 0, (at + 1) & self.mask, at)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.values[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            here = at[open_]
            hit = self.keys[here] == keys[open_]
            out[open_[hit]] = self.values[here[hit]]
            open_ = open_[~hit & (self.values[here] >= 0)]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, n = [""] * 256, 0
    for b in range(256):
        letters[b] = chr(b) if b in own else chr(256 + n)
        n += b not in own
    return letters


class SuffixAutomaton:
    """Of the tokens' symbol strings: child(state, symbol), and for each state its longest proper suffix that is a state and the chain of tokens that end there."""

    def __init__(self, tokens: dict[int, tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, symbols in tokens.items():
            at = 0
            for s in symbols:
                nxt = children[at].get(s)
                if nxt is None:
                    nxt = children[at][s] = len(children)
                    children.append({})
                    token.append(-1)
                at = nxt
            token[at] = t
        suffix, chain, order = [0] * len(children), [0] * len(children), [0]
        for at in order:
            for s, c in children[at].items():
                order.append(c)
                f = suffix[at]
                while at and f and s not in children[f]:
                    f = suffix[f]
                suffix[c] = children[f].get(s, 0) if at else 0
                chain[c] = suffix[c] if token[suffix[c]] >= 0 else chain[suffix[c]]
        keys = np.array([a * 512 + s for a, c in enumerate(children) for s in c], np.uint64)
        self.edges = KeyMap(keys, np.array([x for c in children for x in c.values()], np.int32))
        self.suffix, self.chain, self.token = (np.array(x, np.int32) for x in (suffix, chain, token))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        state = state.copy()
        out, todo = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(todo):
            nxt = self.edges.get(state[todo].astype(np.uint64) * np.uint64(512) + symbol[todo].astype(np.uint64))
            out[todo] = np.maximum(nxt, 0)
            todo = todo[(nxt < 0) & (state[todo] > 0)]
            state[todo] = self.suffix[state[todo]]
        return out


class Bpe:
    """A vocabulary of byte letters with an end-of-word suffix, as in word_bpe_49k.json. encode_words() gives each word's ids."""

    PAIRS = 1 << 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        symbol = {x: i for i, x in enumerate(letters)} | {x + self.end: 256 + i for i, x in enumerate(letters)}
        self.base = np.array([vocab[x] for x in symbol], np.int32)
        symbols = {vocab[x]: (i,) for x, i in symbol.items()}
        # Ids serve as merge ranks below: a merge's id rises with its rank, above the single letters.
        self.left, self.right = np.arange(len(vocab), dtype=np.int64), np.arange(len(vocab), dtype=np.int64)
        pairs, made, last = [], [], max(symbols)
        for a, b in merges:
            t, i, j = vocab[a + b], vocab[a], vocab[b]
            if t <= last:
                raise ValueError("merge ids must rise with their rank")
            last = t
            symbols[t] = symbols[i] + symbols[j]
            self.left[t], self.right[t] = i, j
            pairs.append(i << 32 | j)
            made.append(t)
        self.merge = KeyMap(np.array(pairs, np.uint64), np.array(made, np.int32))
        self.automaton = SuffixAutomaton(symbols)
        self.length = np.zeros(len(vocab), np.int32)
        for t, s in symbols.items():
            self.length[t] = len(s)
        self.pair_key, self.pair_ok = np.full(self.PAIRS, ~np.uint64(0)), np.zeros(self.PAIRS, bool)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.text = {i: t for t, i in (vocab | added).items()}
        import regex

        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.words: dict[str, bytes] = {}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of tokens a and b, side by side, encodes to just a and b. Answers are kept in a table of fixed size."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = ((key * _MIX) >> np.uint64(64 - self.PAIRS.bit_length() + 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            ok[miss] = self._compatible(a[miss].astype(np.int64), b[miss].astype(np.int64))
            self.pair_key[slot[miss]], self.pair_ok[slot[miss]] = key[miss], ok[miss]
        return ok

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the later of the two tokens' merges, again and again: no merge across the border may come before the merges undone so far."""
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.merge.get(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            bad = (across >= 0) & (across < limit[live])
            ok[live[bad]] = False
            # A token that is its own half can't be undone.
            one_x, one_y = self.right[x] == x, self.left[y] == y
            open_left = ~one_x & (one_y | (x > y))
            done = bad | (one_x & one_y)
            # Right of the border an equal rank is applied later, since merging goes from left to right.
            limit[live] = np.where(open_left, x, y + 1)
            a[live], b[live] = np.where(open_left, self.right[x], x), np.where(open_left, y, self.left[y])
            live = live[~done]
        return ok

    def last_tokens(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word (a row of symbols) and each of its prefixes the unique last token of the prefix's encoding."""
        n, width = symbols.shape
        last = np.full((n, width), -1, np.int32)
        state = np.zeros(n, np.int32)
        auto = self.automaton
        for j in range(width):
            live = np.flatnonzero(lengths > j)
            state[live] = auto.step(state[live], symbols[live, j])
            at = state[live]
            at = np.where(auto.token[at] >= 0, at, auto.chain[at])
            while len(live):
                t = auto.token[at]
                before = j - self.length[t]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.compatible(last[live[inner], before[inner]], t[inner])
                last[live[ok], j] = t[ok]
                live, at = live[~ok], auto.chain[at[~ok]]
        return last

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, given as its UTF-8 bytes (not empty). Words of like length are worked on together."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            stop = at
            while stop < len(order) and (stop - at) * len(words[order[stop]]) < 1 << 19 and len(words[order[stop]]) <= 2 * len(words[order[at]]) + 4:
                stop += 1
            group = order[at : max(stop, at + 1)]
            at += len(group)
            lengths = np.array([len(words[i]) for i in group])
            width = int(lengths.max())
            symbols = np.zeros((len(group), width), np.int16)
            flat = np.frombuffer(b"".join(words[i] for i in group), np.uint8)
            symbols[np.arange(width) < lengths[:, None]] = flat
            symbols[np.arange(len(group)), lengths - 1] += 256
            last = self.last_tokens(symbols, lengths)
            ids = np.zeros((len(group), width), np.int32)
            pos, n, live = lengths.copy(), np.zeros(len(group), np.int64), np.arange(len(group))
            while len(live):
                t = last[live, pos[live] - 1]
                n[live] += 1
                ids[live, width - n[live]] = t
                pos[live] -= self.length[t]
                live = live[pos[live] > 0]
            for k, i in enumerate(group):
                out[i] = ids[k, width - n[k] :]
        return out

    def _pieces(self, chunk: str) -> list:
        """Words and ids of added tokens of a chunk: added tokens are found in the text as it is, the rest is normalised and split."""
        parts, out = self.special.split(chunk) if self.special else [chunk], []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part])
            elif part:
                text = unicodedata.normalize("NFC", part)
                # Each letter by itself: str.lower() alone would look at the neighbours of a capital sigma.
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
                out += self.word.findall(text)
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of chunks without spaces or line feeds."""
        pieces = [self._pieces(c) for c in chunks]
        new = sorted({w for p in pieces for w in p if isinstance(w, str) and w not in self.words})
        if len(self.words) > 300_000:
            keep = {w for p in pieces for w in p if isinstance(w, str) and w in self.words}
            self.words = {w: self.words[w] for w in keep}
        for w, ids in zip(new, self.encode_words([w.encode() for w in new])):
            self.words[w] = ids.astype("<u4").tobytes()
        return [b"".join(self.words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p) for p in pieces]

    def decode(self, ids) -> str:
        """The tokens' texts, joined by spaces: what a vocabulary file without a decoder means. Unknown ids are left out."""
        return " ".join([x for x in map(self.text.get, ids) if x is not None])


def worker_cache(path: str) -> tuple[Bpe, ByteChunks]:
    """The vocabulary and the ids of the chunks of texts; a Python worker keeps them from task to task."""

    def make():
        bpe = Bpe(path)
        return bpe, ByteChunks(bpe.encode_chunks, "<u4")

    return held(("bpe", path), make)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each whole text, for callers on one machine."""
    out = []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.string())):
        ids, at = worker_cache(path)[1].rows(data, offsets)
        out += [ids[x:y] for x, y in zip(at.tolist(), at[1:].tolist())]
    return out


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, ids (array of int) and decoded text, the ids decoded again.

    Null text counts as empty: no ids, an empty decoded text. A null id stays null; repeated rows give repeated rows. Other
    columns are not read. The vocabulary is loaded once for each Python worker; a worker keeps a bounded number of chunks.
    """

    def run(batches):
        bpe, cache = worker_cache(tokenizer)
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(1)):
                ids, at = cache.rows(data, offsets)
                texts = [bpe.decode(ids[x:y].tolist()) for x, y in zip(at.tolist(), at[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return _text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Training rows: doc_id, source, n_tokens, ids (array of int). Null text gives no ids; rows that repeat stay repeated."""

    def run(batches):
        cache = worker_cache(tokenizer)[1]
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(2)):
                ids, at = cache.rows(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(np.diff(at)), lists], names=["doc_id", "source", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_documents() gives, without moving ids and texts out of the workers."""

    def run(batches):
        bpe, cache = worker_cache(tokenizer)
        for b in batches:
            for i, j, data, offsets in text_slices(b.column(1)):
                ids, at = cache.rows(data, offsets)
                rows = []
                for x, y in zip(at.tolist(), at[1:].tolist()):
                    text = bpe.decode(ids[x:y].tolist()).encode()
                    rows.append((y - x, hashlib.sha256(ids[x:y].tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types[1:])]], schema=_OUT)

    return _text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
