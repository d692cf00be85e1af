"""Exact deduplication by a Grace hash: partitions, then spill files, until each bucket fits an open-addressing table that compares complete content.

Level 0 of the partitioning is Spark's own shuffle by digest. Before it, each map task combines the equal texts that it
holds, so a text that a third of all rows repeat crosses the network once for each flush of a map task, not once for each row.
Inside a reduce task a table that outgrows its budget is dealt to spill files by further bits of the hash, and each file is
treated in the same way, with the next bits. Tables hold a distinct text once, so copies alone never force a spill.

The digest (SHA-256) deals records out and carries the decision back to the rows; whether two texts are equal is decided by
comparing the texts. Should two different texts ever share a digest, the operator raises instead of merging them.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.chunks import fresh, release
from siftlog.llm.lookup import heaviest, look_up
from siftlog.session import written

#: Bytes of distinct text that one table holds before it is flushed (map side) or dealt to spill files (reduce side).
TABLE_BYTES = 32 << 20
FANOUT_BITS = 4
_HEAD = struct.Struct("<32sqBqqI")


class OpenTable:
    """Open addressing with linear probing over 64 bits of the digest; an entry matches when its complete content does."""

    def __init__(self, slots: int = 1024):
        self.mask = slots - 1
        self.slots = [-1] * slots
        self.tags: list[int] = []
        self.entries: list[list] = []  # [digest, content, greatest id or None, rows, rows with that id]
        self.bytes = 0

    def _place(self, tag: int) -> int:
        i = tag & self.mask
        while self.slots[i] >= 0:
            i = (i + 1) & self.mask
        return i

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, tag in enumerate(self.tags):
            self.slots[self._place(tag)] = k

    def add(self, digest: bytes, content: bytes, top: int | None, rows: int, rows_top: int) -> None:
        tag = int.from_bytes(digest[:8], "little")
        i = tag & self.mask
        while (k := self.slots[i]) >= 0:
            e = self.entries[k]
            if self.tags[k] == tag and e[1] == content:
                e[3] += rows
                if e[2] == top:
                    e[4] += rows_top
                elif e[2] is None or (top is not None and top > e[2]):
                    e[2], e[4] = top, rows_top
                return
            i = (i + 1) & self.mask
        self.slots[i] = len(self.entries)
        self.tags.append(tag)
        self.entries.append([digest, content, top, rows, rows_top])
        self.bytes += len(content) + 300
        if 2 * len(self.entries) > self.mask:
            self._grow()


def _spill(f, e) -> None:
    digest, content, top, rows, rows_top = e
    f.write(_HEAD.pack(digest, top or 0, top is None, rows, rows_top, len(content)))
    f.write(content)


def _unspill(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            digest, top, none, rows, rows_top, n = _HEAD.unpack(head)
            yield digest, f.read(n), None if none else top, rows, rows_top


def grace(records: Iterator[tuple], budget: int, level: int = 0) -> Iterator[list]:
    """One entry for each distinct content among the records. Spill files live in the worker's own temporary folder and go with it."""
    table = OpenTable()
    for r in records:
        table.add(*r)
        if table.bytes > budget and level < 48 // FANOUT_BITS:
            break
    else:
        yield from table.entries
        return
    shift, mask = 64 + FANOUT_BITS * level, (1 << FANOUT_BITS) - 1
    with tempfile.TemporaryDirectory(prefix="grace-") as d:
        paths = [os.path.join(d, str(b)) for b in range(mask + 1)]
        files = [open(p, "wb") for p in paths]  # noqa: SIM115
        bucket = lambda digest: (int.from_bytes(digest[:16], "little") >> shift) & mask
        try:
            for e in table.entries:
                _spill(files[bucket(e[0])], e)
            del table
            for r in records:
                _spill(files[bucket(r[0])], r)
        finally:
            for f in files:
                f.close()
        for p in paths:
            yield from grace(_unspill(p), budget, level + 1)
            os.unlink(p)


_PART = "digest binary, content binary, top long, rows long, rows_top long"
_ARROW = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("top", pa.int64()), ("rows", pa.int64()), ("rows_top", pa.int64())])
_GROUPS = "digest binary, keep_id long, group_size long, rows_top long"
_GROUPS_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("rows_top", pa.int64())])


def _emit(entries, schema, limit: int = 8 << 20, pick=lambda e: e) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for e in entries:
        rows.append(pick(e))
        size += len(e[1]) + 100
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _combine(budget: int):
    def run(batches):
        release()
        table = OpenTable()
        for b in batches:
            for digest, content, top in zip(*(c.to_pylist() for c in b.columns)):
                table.add(digest, content, top, 1, 1)
                if table.bytes > budget:
                    yield from _emit(table.entries, _ARROW)
                    table = OpenTable()
        yield from _emit(table.entries, _ARROW)

    return run


def _reduce(budget: int):
    def run(batches):
        release()
        records = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield from _emit(grace(records, budget), _GROUPS_ARROW, pick=lambda e: (e[0], e[2], e[3], e[4]))

    return run


def normal_text(text: Column, normalize: Callable[[Column], Column] | None = None) -> Column:
    full = F.coalesce(text.cast("string"), F.lit(""))
    return normalize(full) if normalize else full


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct normalised text: digest, keep_id (its greatest id), group_size, rows_top (rows that carry that id)."""
    text = normal_text(F.col(text_col), normalize)
    rows = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.cast("binary").alias("content"), F.col(id_col).cast("long").alias("top"))
    combined = rows.mapInArrow(_combine(table_bytes), _PART)
    return combined.repartition("digest").mapInArrow(_reduce(table_bytes), _GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, rows_top.

    Null text counts as the empty text. Of equal texts the greatest id stays; a null id is below every other, and a group of
    null ids only keeps null. Rows that repeat the kept id and text are all marked kept (rows_top counts them);
    drop_copies() leaves one. Other columns of docs, whatever their names, are not touched. No rows give no rows.
    """
    text = normal_text(F.col(text_col), normalize)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    # A second row for a digest means that two contents share it.
    copies = written(text_groups(docs, id_col, text_col, normalize, table_bytes).where("group_size > 1").withColumnRenamed("digest", "g_digest").withColumn("found", F.lit(True)), "grace-groups")
    out = look_up(ids, "digest", copies, "g_digest", "group_size", F.col("doc_id"))
    found = F.col("found").isNotNull()
    return out.select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.coalesce("rows_top", F.lit(1)).cast("long").alias("rows_top"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, less the copies: each distinct text stays once, under its greatest id."""
    key, g_key, keep, many, h_key, h_keep = fresh(docs.columns, "grace_digest", "grace_group", "grace_keep", "grace_many", "grace_hot", "grace_hot_keep")
    groups = written(text_groups(docs, id_col, text_col, normalize, table_bytes).where("group_size > 1"), "grace-groups")
    copies = groups.select(F.col("digest").alias(g_key), F.col("keep_id").alias(keep), (F.col("rows_top") > 1).alias(many))
    text = normal_text(docs[text_col], normalize)
    # Copies in the largest groups go before anything is shuffled.
    hot = heaviest(groups, "digest", "group_size").select(F.col("digest").alias(h_key), F.col("keep_id").alias(h_keep))
    rows = docs.withColumn(key, F.unhex(F.sha2(text.cast("binary"), 256))).join(F.broadcast(hot), F.col(key) == F.col(h_key), "left")
    rows = rows.where(F.col(h_key).isNull() | F.col(id_col).cast("long").eqNullSafe(F.col(h_keep))).drop(h_key, h_keep)
    marked = rows.join(copies, F.col(key) == F.col(g_key), "left")
    stays = F.col(g_key).isNull() | F.col(id_col).cast("long").eqNullSafe(F.col(keep))
    # Rows that repeat both id and text are rare: only they are dealt out once more.
    single = marked.where(stays & ~F.coalesce(F.col(many), F.lit(False)))
    repeated = marked.where(stays & F.coalesce(F.col(many), F.lit(False))).dropDuplicates([key])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
