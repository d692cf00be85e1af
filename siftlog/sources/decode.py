"""From a file's bytes to records. Runs in Python workers, one file at a time."""

from __future__ import annotations

import gzip
import io
import json
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from siftlog.errors import EngineError
from siftlog.sources.expand import is_archive, is_gzip, kind_of

BLANK = re.compile(rb"[ \t\n\r\f\v]*\Z")
LINE_LIMIT, PROBE = 4096, 4096


@dataclass(frozen=True)
class Limits:
    """What an archive may expand to. Fixed values."""

    entry_bytes: int = 256 << 20
    total_bytes: int = 2 << 30
    entries: int = 100_000
    ratio: int = 1000


@dataclass
class Record:
    source: str
    line_number: int
    byte_offset: int
    byte_length: int
    array_element: bool
    text: str | None
    skip_reason: str | None = None
    truncated: bool = False


def _keep(source: str, n: int, at: int, size: int, element: bool, text: str) -> Record:
    return Record(source, n, at, size, element, text[:LINE_LIMIT], None, len(text) > LINE_LIMIT)


def _blank(text: str) -> bool:
    return not text.strip(" \t\n\r\f\v")


def _no_constants(name: str):
    raise ValueError(name)


def parse_json(raw: bytes):
    """Strict JSON: nothing behind the document, no NaN; of repeated keys the last counts."""
    return json.loads(raw.decode("utf-8"), parse_constant=_no_constants)


def _field(value, name: str) -> tuple[str | None, str | None]:
    """(text, reason to skip)."""
    text = value.get(name) if isinstance(value, dict) else None
    if not isinstance(text, str):
        return None, "missing_field"
    return (None, "empty") if _blank(text) else (text, None)


def raw_lines(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, line) at line feeds alone; a last line without one counts."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        yield at, data[at:end]
        at = end + 1


def numbered(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    return ((n, at, raw) for n, (at, raw) in enumerate(raw_lines(data), 1))


def lines(source: str, found: Iterator[tuple[int, int, bytes]]) -> Iterator[Record]:
    """Records of (line number, offset, bytes without the line feed)."""
    for n, at, raw in found:
        raw = raw[:-1] if raw.endswith(b"\r") else raw
        if BLANK.match(raw):
            yield Record(source, n, at, len(raw), False, None, "empty")
        else:
            yield _keep(source, n, at, len(raw), False, raw.decode("utf-8", "replace"))


def json_lines(source: str, found: Iterator[tuple[int, int, bytes]], name: str) -> Iterator[Record]:
    for n, at, raw in found:
        raw = raw[:-1] if raw.endswith(b"\r") else raw
        text, reason = None, "empty"
        if not BLANK.match(raw):
            try:
                text, reason = _field(parse_json(raw), name)
            except (ValueError, RecursionError):
                reason = "malformed"
        yield Record(source, n, at, len(raw), False, None, reason) if text is None else _keep(source, n, at, len(raw), False, text)


def of_kind(kind: str, source: str, found: Iterator[tuple[int, int, bytes]], name: str) -> Iterator[Record]:
    return json_lines(source, found, name) if kind == "jsonl" else lines(source, found)


def lines_from(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end) of an open file, one at a time."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1
    while at < end and (raw := f.readline()):
        yield at, raw[:-1] if raw.endswith(b"\n") else raw
        at += len(raw)


def json_document(source: str, data: bytes, name: str) -> Iterator[Record]:
    """An object is line 1; an array's elements count from 1, skipped ones too; an invalid document is one malformed record."""
    try:
        value = parse_json(data)
    except (ValueError, RecursionError):
        yield Record(source, 1, 0, len(data), False, None, "malformed")
        return
    element = isinstance(value, list)
    for n, v in enumerate(value if element else [value], 1):
        text, reason = _field(v, name)
        yield Record(source, n, 0, len(data), element, None, reason) if text is None else _keep(source, n, 0, len(data), element, text)


def binary(data: bytes) -> bool:
    return b"\0" in data[:PROBE]


def openpgp(data: bytes) -> bool:
    """An armoured message, or an old or new packet header of an encrypted session key or of encrypted data."""
    if data.startswith(b"-----BEGIN PGP MESSAGE-----"):
        return True
    if len(data) < 3 or not data[0] & 0x80:
        return False
    tag = data[0] & 0x3F if data[0] & 0x40 else (data[0] >> 2) & 0x0F
    version = data[3] if data[0] & 0x40 == 0 and data[0] & 3 == 1 and len(data) > 3 else data[2]
    return (tag == 1 and version == 3) or (tag == 3 and version in (4, 5)) or (tag == 18 and version == 1)


def gunzip(data: bytes, path: str, limit: int | None = None) -> bytes:
    """All members of a gzip stream on end; anything short or damaged is an error."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read() if limit is None else f.read(limit + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise EngineError("parse", "corrupt_gzip", path) from e
    if limit is not None and len(out) > limit:
        raise EngineError("parse", "archive_limit", path, f"an archive entry is larger than {limit} bytes")
    return out


def text_records(source: str, name: str, data: bytes, field: str) -> Iterator[Record]:
    kind = kind_of(name)
    return json_document(source, data, field) if kind == "json" else of_kind(kind, source, numbered(data), field)


def label(name: str) -> str:
    name = name.replace("\\", "/")
    while name.startswith("./"):
        name = name[2:]
    return name.rstrip("/")


class _Budget:
    def __init__(self, limits: Limits, packed: int, path: str):
        self.limits, self.packed, self.path, self.total, self.count = limits, max(packed, 1), path, 0, 0

    def fail(self, note: str):
        raise EngineError("parse", "archive_limit", self.path, note)

    def entry(self) -> None:
        self.count += 1
        if self.count > self.limits.entries:
            self.fail(f"the archive entry count exceeds {self.limits.entries}")

    def size(self, n: int) -> None:
        """Before reading, on the declared size."""
        if n > self.limits.entry_bytes:
            self.fail(f"an archive entry is larger than {self.limits.entry_bytes} bytes")
        if self.total + n > self.limits.total_bytes:
            self.fail(f"the archive expands past {self.limits.total_bytes} uncompressed bytes")

    def took(self, n: int) -> None:
        self.size(n)
        self.total += n
        if self.total > self.limits.ratio * self.packed and self.total > 1 << 20:
            self.fail(f"the archive compression ratio exceeds {self.limits.ratio}")


def _tar_members(data: bytes, path: str, budget: _Budget, skipped: dict[str, int]) -> Iterator[tuple[str, bytes]]:
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                budget.entry()
                kind = "directories" if m.isdir() else "symlinks" if m.issym() else "hardlinks" if m.islnk() else "" if m.isfile() else "other"
                if kind:
                    skipped[kind] = skipped.get(kind, 0) + 1
                    continue
                budget.size(m.size)
                yield m.name, t.extractfile(m).read(budget.limits.entry_bytes + 1)
    except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError) as e:
        raise EngineError("parse", "corrupt_archive", path) from e


def _zip_members(data: bytes, path: str, budget: _Budget, skipped: dict[str, int]) -> Iterator[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in sorted(z.infolist(), key=lambda m: m.header_offset):
                budget.entry()
                mode = (m.external_attr >> 16) & 0o170000
                kind = "directories" if m.is_dir() else "symlinks" if mode == 0o120000 else "other" if mode not in (0, 0o100000) else ""
                if kind:
                    skipped[kind] = skipped.get(kind, 0) + 1
                    continue
                if m.flag_bits & 1:
                    raise EngineError("parse", "encrypted_archive", path)
                budget.size(m.file_size)
                with z.open(m) as f:
                    yield m.filename, f.read(budget.limits.entry_bytes + 1)
    except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError) as e:
        raise EngineError("parse", "corrupt_archive", path) from e


def archive(path: str, data: bytes, field: str, limits: Limits, skipped: dict[str, int]) -> Iterator[Record]:
    """Members in the archive's order, labelled bundle:member; members that are packed with gzip are unpacked, binary ones counted."""
    budget = _Budget(limits, len(data), path)
    members = _zip_members if path.lower().endswith(".zip") else _tar_members
    for name, content in members(data, path, budget, skipped):
        budget.took(len(content))
        member = label(name)
        if is_gzip(member):
            content = gunzip(content, f"{path}:{member}", limits.entry_bytes)
            budget.took(len(content))
        if binary(content):
            skipped["binary"] = skipped.get("binary", 0) + 1
            continue
        yield from text_records(f"{path}:{member}", member, content, field)


def probe(path: str, head: bytes) -> None:
    """Refuse a file by its first bytes."""
    if openpgp(head):
        raise EngineError("parse", "encrypted_archive", path)
    if binary(head):
        raise EngineError("parse", "binary_file", path)


def records(path: str, data: bytes, field: str = "message", limits: Limits | None = None, skipped: dict[str, int] | None = None) -> Iterator[Record]:
    """All records of one file. skipped counts an archive's entries that gave none."""
    skipped = {} if skipped is None else skipped
    if openpgp(data):
        raise EngineError("parse", "encrypted_archive", path)
    if is_archive(path):
        yield from archive(path, data, field, limits or Limits(), skipped)
        return
    data = gunzip(data, path) if is_gzip(path) else data
    if binary(data):
        raise EngineError("parse", "binary_file", path)
    yield from text_records(path, path, data, field)


def read_record(path: str, record: Record, field: str = "message") -> str | None:
    """One record's text again, from a plain or gzip file: lines by their bytes, JSON by its ordinal. Standard input and archive members can't be read twice."""
    if path == "-" or is_archive(path):
        raise EngineError("parse", "unsupported_format", path)
    with open(path, "rb") as f:
        if kind_of(path) == "lines" and not is_gzip(path):
            f.seek(record.byte_offset)
            return f.read(record.byte_length).decode("utf-8", "replace")[:LINE_LIMIT]
        data = f.read()
    found = (r for r in records(path, data, field) if r.line_number == record.line_number)
    return next((r.text for r in found), None)
