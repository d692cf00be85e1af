"""Which files an input names, and in what order: the order is a part of every result."""

from __future__ import annotations

import os
import re
import stat

from pyspark.sql import SparkSession

from siftlog.errors import EngineError

ARCHIVES = (".tar", ".tgz", ".tar.gz", ".tar.xz", ".zip")


def _status(path: str):
    """(Hadoop file system, status) of a path in a store; an error if it isn't there."""
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise EngineError("parse", "file_open", path)
    return fs, fs.getFileStatus(p)


def in_store(path: str) -> bool:
    return "://" in path


#: Of file:/x and file:///x, which are one place, the latter becomes the former.
LOCAL = ("^file:/+", "file:/")


def qualified(path: str) -> str:
    """A store's own spelling of a path, as Spark's readers show it, but for LOCAL."""
    return re.sub(*LOCAL, _status(path)[1].getPath().toUri().toString())


def _store_files(path: str) -> list[str]:
    fs, status = _status(path)
    if not status.isDirectory():
        return [path]
    top, found, files = status.getPath().toUri().getPath(), [], fs.listFiles(status.getPath(), True)
    while files.hasNext():
        found.append(path.rstrip("/") + files.next().getPath().toUri().getPath()[len(top) :])
    return sorted(found, key=str.encode)


def expand(paths: list[str]) -> list[str]:
    """Arguments in order; a directory gives its regular files, at any depth, by the bytes of their paths. - stays.

    Links to directories are not followed, links to files are kept; a dangling link or a missing path is an error; other
    kinds of files are left out of directories. Paths with a scheme (s3a://, hdfs://) are listed by the session's file system.
    """
    out: list[str] = []
    for p in paths:
        if p == "-":
            out.append(p)
        elif in_store(p):
            out += _store_files(p)
        elif os.path.isdir(p):
            found = []
            for d, dirs, names in os.walk(p):
                dirs[:] = [x for x in dirs if not os.path.islink(os.path.join(d, x))]
                for n in names:
                    full = os.path.join(d, n)
                    try:
                        kind = os.stat(full).st_mode
                    except OSError as e:
                        raise EngineError("parse", "file_open", full) from e
                    if stat.S_ISREG(kind):
                        found.append(full)
            out += sorted(found, key=os.fsencode)
        elif os.path.isfile(p):
            out.append(p)
        else:
            raise EngineError("parse", "file_open", p)
    return out


def is_archive(path: str) -> bool:
    return path.lower().endswith(ARCHIVES)


def is_gzip(path: str) -> bool:
    return path.lower().endswith(".gz") and not is_archive(path)


def kind_of(path: str) -> str:
    """json, jsonl or lines, by the extension before .gz."""
    name = path.lower()
    name = name[:-3] if is_gzip(name) else name
    return "json" if name.endswith(".json") else "jsonl" if name.endswith(".jsonl") else "lines"


def _state(path: str) -> tuple[int, int]:
    """(size, modified in nanoseconds)."""
    if in_store(path):
        status = _status(path)[1]
        return status.getLen(), status.getModificationTime() * 1_000_000
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns


def fingerprints(paths: list[str]) -> list[tuple[int, str, int, int, bool]]:
    """(source_index, path, size, modified in nanoseconds, tracked); standard input is not tracked."""
    out = []
    for i, p in enumerate(paths):
        if p == "-":
            out.append((i, p, 0, 0, False))
            continue
        try:
            out.append((i, p, *_state(p), True))
        except OSError as e:
            raise EngineError("parse", "file_open", p) from e
    return out


def stale(sources: list[tuple[str, int, int, bool]]) -> list[tuple[str, str]]:
    """(path, changed | missing | unreadable) for sources (path, size, modified, tracked) that are no longer what was indexed; each path once."""
    out: dict[str, str] = {}
    for path, size, modified, tracked in sources:
        if not tracked:
            if path != "-":
                out.setdefault(path, "unreadable")
            continue
        try:
            now = _state(path)
        except (OSError, EngineError):
            out[path] = "missing"
            continue
        if now != (size, modified):
            out.setdefault(path, "changed")
    return list(out.items())
