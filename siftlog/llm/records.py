"""Token ids as length-delimited binary records, with an offset index in a separate table.

A shard file is a sequence of records, in ascending document order over the shards' names:

    u64 length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload | 0A

all little-endian. The payload is: i64 document id | u8 flags (1: the id is null) | u8 bytes for an id (2 or 4) | the ids.
A checksum c (CRC-32) is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32, so that checksums of data that themselves
hold checksums stay useful. Shards are written by Spark's own file commit, to any store that Spark can write: a task that
dies leaves no half file behind. The index has doc_id, shard, offset, length, n_tokens and start for each record, found by
scanning the shards, which checks every frame on the way.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftlog.llm.chunks import ByteChunks, ChunkCache, held, text_slices
from siftlog.session import new_path

_LEN, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
END = b"\n"
#: Bytes of a shard at most, but for a longer record. A shard is read as a whole.
SHARD_BYTES = 128 << 20
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its end byte, which Spark's line-by-line sink adds."""
    n = _LEN.pack(len(payload))
    return b"".join((n, _SUM.pack(masked(n)), payload, _SUM.pack(masked(payload))))


def frames(data) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length of the whole record, payload) of every record; raises ValueError where a length, checksum or end is wrong."""
    view, at = memoryview(data), 0
    while at < len(view):
        head = view[at : at + 12]
        if len(head) < 12 or _SUM.unpack(head[8:])[0] != masked(head[:8]):
            raise ValueError(f"damaged record length at offset {at}")
        n = _LEN.unpack(head[:8])[0]
        end = at + 12 + n + 4 + 1
        payload = view[at + 12 : at + 12 + n]
        if end > len(view) or _SUM.unpack(view[end - 5 : end - 1])[0] != masked(payload) or view[end - 1 : end] != END:
            raise ValueError(f"damaged record at offset {at}")
        yield at, end - at, payload
        at = end


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width) + ids


def unpack(payload) -> tuple[int | None, np.ndarray]:
    doc_id, none, width = _HEAD.unpack(payload[: _HEAD.size])
    return None if none else doc_id, np.frombuffer(payload[_HEAD.size :], "<u2" if width == 2 else "<u4")


#: Words or chunks that the library encodes in one call.
TOGETHER = 1024
#: A chunk of these letters, each a letter in every normal form and in lower case, and then of these marks.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


class LibraryEncoder:
    """Ids of chunks, as bytes, with the tokenizers library.

    The library's calls cost more than its work on a short text, so many texts share a call where the result shows where each
    ends. Where the vocabulary ends every word with a token of its own kind, words of plain letters are joined by spaces: each
    has one such token, its last. Other chunks are joined by a special token, at which the library cuts a text before anything
    else; a chunk that could hold a part of a special token is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.library = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        size = t.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        added = t.get_added_tokens_decoder()
        self.between = next(((i, x.content) for i, x in added.items() if x.special and not (x.normalized or x.lstrip or x.rstrip or x.single_word)), None)
        self.special = {c for x in added.values() for c in (x.content[0], x.content[-1])}
        self.words = ChunkCache(self._words, 100_000)
        suffix, self.last = getattr(t.model, "end_of_word_suffix", None), None
        if suffix:
            self.last = np.zeros(size, bool)
            self.last[[i for x, i in t.get_vocab(with_added_tokens=False).items() if x.endswith(suffix)]] = True
            probe = ["a", "it", "is", "zz", ".,", "\u00e9t\u00e9", "."]
            if self._words(probe) != [self._one(x) for x in probe]:
                self.last = None  # words are not cut at white space and marks, as assumed

    def _one(self, chunk: str) -> bytes:
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def _cut(self, text: str, ends) -> tuple[bytes, list[int]]:
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        return ids.tobytes(), np.flatnonzero(ends(ids)).tolist()

    def _words(self, words: list[str]) -> list[bytes]:
        out, w = [], self.width
        for k in range(0, len(words), TOGETHER):
            block = words[k : k + TOGETHER]
            raw, last = self._cut(" ".join(block), lambda ids: self.last[ids])
            if len(last) == len(block):
                out += [raw[w * a : w * e] for a, e in zip([0, *[x + 1 for x in last[:-1]]], [x + 1 for x in last])]
            else:
                out += [self._one(x) for x in block]
        return out

    def chunks(self, chunks: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(c) for c in chunks] if self.last is not None else [None] * len(chunks)
        known = self.words.lookup({x for m in plain if m for x in m.groups() if x})
        known[""] = b""
        rest = [c for c, m in zip(chunks, plain) if not m]
        odd: dict[str, bytes] = {c: self._one(c) for c in rest if self.between is None or not self.special.isdisjoint(c)}
        rest, w = [c for c in rest if c not in odd], self.width
        for k in range(0, len(rest), TOGETHER):
            block = rest[k : k + TOGETHER]
            raw, marks = self._cut(self.between[1].join(block), lambda ids: ids == self.between[0])
            odd.update((c, raw[w * a : w * e]) for c, a, e in zip(block, [0, *[x + 1 for x in marks]], [*marks, len(raw) // w]))
        return [known[m[1]] + known[m[2]] if m else odd[c] for c, m in zip(chunks, plain)]


def library_cache(path: str) -> tuple[ByteChunks, int]:
    """(ids of the chunks of texts, bytes for an id); a Python worker keeps it from task to task."""

    def make():
        encoder = LibraryEncoder(path)
        return ByteChunks(encoder.chunks, encoder.kind), encoder.width

    return held(("library", path), make)


def _encode(tokenizer: str, end_id: int | None, shard_bytes: int):
    """Rows (piece, frame): a task's frames in order, a new piece before shard_bytes are passed."""

    def run(batches):
        cache, width = library_cache(tokenizer)
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        piece, size = 0, 0
        for b in batches:
            keys = b.column(0).to_pylist()
            for i, j, data, offsets in text_slices(b.column(1)):
                ids, at = cache.rows(data, offsets)
                raw, at = ids.tobytes(), (at * width).tolist()
                rows, pieces = [], []
                for d, x, y in zip(keys[i:j], at, at[1:]):
                    rows.append(frame(pack(d, raw[x:y] + end, width)))
                    if size and size + len(rows[-1]) >= shard_bytes:
                        piece, size = piece + 1, 0
                    size += len(rows[-1]) + 1
                    pieces.append(piece)
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(rows, pa.binary())], names=["piece", "frame"])

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the shards below path, in ascending id order.

    Null text counts as empty (a record with the end id alone, or no id). Rows without an id come first; rows that share an
    id follow one another in the order of their texts. Other columns are not read. No rows give a folder without records.
    Texts are sorted before they are encoded, since they pack better than ids: the one shuffle carries them alone. There are as
    many ranges as the texts' bytes ask for, and a task cuts its range into pieces: no shard has more than shard_bytes, but for
    one that holds a single record. Shards are in the order of their range's number, then of their piece's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(-(-size // shard_bytes), 2 * spark.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = ordered.mapInArrow(_encode(tokenizer, end_id, shard_bytes), "piece int, frame binary").select("piece", F.col("frame").cast("string").alias("value"))
    # With a writer open for each piece, Spark doesn't sort a task's rows by piece, so they stay in order.
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, str(1 << 20))
    try:
        found.write.partitionBy("piece").option("lineSep", "\n").text(path)
    finally:
        spark.conf.set(WRITERS, before)


_SCAN = "doc_id long, shard string, offset long, length long, n_tokens long, ids_crc32 long, in_shard long"
_SCAN_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("in_shard", pa.int64())])


def _scan(batches):
    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1)):
            rows, before = [], 0
            for at, n, payload in frames(data.as_buffer()):
                doc_id, ids = unpack(payload)
                rows.append((doc_id, "/".join(path.rsplit("/", 2)[-2:]), at, n, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                before += len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCAN_ARROW.types)], schema=_SCAN_ARROW)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _with_start(rows: DataFrame) -> DataFrame:
    """start: the ids of all records before. One row for each shard, its number of ids, is summed over the shards in one place."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    number = lambda pattern: F.regexp_extract("shard", pattern, 1).cast("int")
    in_order = Window.orderBy(number(r"/part-(\d+)"), number(r"piece=(\d+)/"))
    first = totals.select("shard", (F.sum("ids").over(in_order) - F.col("ids")).alias("before"))
    return rows.join(first, "shard").select("doc_id", "shard", "offset", "length", "n_tokens", "ids_crc32", (F.col("in_shard") + F.col("before")).alias("start"))


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Read every shard back, checking each frame: doc_id, shard, offset, length, n_tokens, ids_crc32, start."""
    return _with_start(_files(spark, path).mapInArrow(_scan, _SCAN))


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Scan the shards once, keep what was found in a table of its own at index_path and return it with start."""
    rows = _files(spark, path).mapInArrow(_scan, _SCAN)
    rows.write.parquet(index_path)
    return _with_start(spark.read.schema(rows.schema).parquet(index_path))


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records that index (doc_id, shard, offset, length) names, in any order: doc_id, ids. For shuffled reads: sample or reorder the index, not the data.

    Each shard is opened once, whatever the number of its records that are asked for.
    """

    def run(batches):
        for b in batches:
            for data, offsets in zip(b.column(0), b.column(1).to_pylist()):
                view, rows = memoryview(data.as_buffer()), []
                for o in offsets:
                    _, _, payload = next(frames(view[o["offset"] : o["offset"] + o["length"]]))
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, ids.astype("<i8")))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    wanted = index.groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("at"))  # a shard's records, bounded by its size
    files = _files(spark, path).withColumn("shard", F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"))
    return files.join(wanted, "shard").select("content", "at").mapInArrow(run, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the records and their index below the shared folder, and return what the index and the files say."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    write_records(docs, f"{path}/shards", tokenizer, end_id, id_col, text_col, shard_bytes)
    return write_index(spark, f"{path}/shards", f"{path}/index")
