"""Results and messages as text. Works on the k rows that a search returns, on the driver."""

from __future__ import annotations

import json
import math

import numpy as np

from siftlog.errors import Report

# Fixed value.
SCHEMA_VERSION = 2


def escape(text: str | bytes) -> str:
    """Control characters made visible: \\xHH below 20 and 7F, \\u00HH for 80 to 9F, \\xHH for bytes that are not UTF-8."""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "surrogateescape")
    out = []
    for c in text:
        p = ord(c)
        if p < 0x20 or p == 0x7F:
            out.append(f"\\x{p:02X}")
        elif 0x80 <= p <= 0x9F:
            out.append(f"\\u00{p:02X}")
        elif 0xDC80 <= p <= 0xDCFF:
            out.append(f"\\x{p - 0xDC00:02X}")
        else:
            out.append(c)
    return "".join(out)


def shortest(x: float | None) -> str:
    """The shortest digits that give the same float32 again, in the shorter of the two notations."""
    if x is None:
        return "null"
    f = np.float32(x)
    if math.isnan(f) or math.isinf(f):
        return str(float(f))
    if f == 0:
        return "-0" if np.signbit(f) else "0"
    plain = np.format_float_positional(f, unique=True, trim="-")
    powers = np.format_float_scientific(f, unique=True, trim="-", exp_digits=2)
    return powers if len(powers) < len(plain) else plain


def text_line(row, report: Report) -> str:
    prefixed = report.multiple_sources or row["source"] == "-" or ":" in row["source"]
    place = f"{row['kind']} {row['line']}" + (f" ({row['occurrences']})" if report.grouped else "")
    return (f"{escape(row['source'])}:" if prefixed else "") + f"{place}: {row['score']:.4f}: {escape(row['text'])}"


def json_line(row) -> str:
    text = lambda s: json.dumps(s.encode("utf-8", "replace").decode(), ensure_ascii=False)
    parts = [
        ("schema_version", str(SCHEMA_VERSION)), ("rank", str(row["rank"])), ("source", text(row["source"])), ("kind", text(row["kind"])), ("line", str(row["line"])), ("score", shortest(row["score"])),
        ("text", text(row["text"])), ("occurrences", str(row["occurrences"])), ("mode", text(row["mode"])), ("dense", shortest(row["dense"])), ("lexical", shortest(row["lexical"])),
    ]
    return "{" + ",".join(f'"{k}":{v}' for k, v in parts) + "}"


def _count(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def _and(parts: list[str]) -> str:
    return " and ".join(parts) if len(parts) < 3 else ", ".join(parts[:-1]) + ", and " + parts[-1]


def bundle_message(path: str, kinds: dict[str, int]) -> str:
    # What is counted, in this order.
    names = {"directories": ("directory", "directories"), "symlinks": ("symlink", "symlinks"), "hardlinks": ("hard link", "hard links"), "other": ("non-regular entry", "non-regular entries"), "binary": ("binary file", "binary files")}
    total = sum(kinds.get(k, 0) for k in names)
    if not total:
        return ""
    return f"Skipped {_count(total, 'entry', 'entries')} in '{path}' ({_and([_count(kinds[k], *n) for k, n in names.items() if kinds.get(k)])})."


def messages(report: Report) -> list[str]:
    """What goes to standard error."""
    out, parts = [], []
    if report.empty:
        parts.append(_count(report.empty, "empty line", "empty lines"))
    if report.malformed:
        parts.append(_count(report.malformed, "malformed line", "malformed lines"))
    if report.missing_field:
        parts.append(f'{_count(report.missing_field, "line missing", "lines missing")} the "{report.json_field}" field')
    if parts:
        out.append(f"Skipped {_and(parts)}.")
    out += [m for m in (bundle_message(p, k) for p, k in report.bundles.items()) if m]
    if report.truncated:
        out.append(f"Truncated {_count(report.truncated, 'line', 'lines')}.")
    if report.policy_mismatch:
        out.append("Warning: corpus indexing policy differs from this build; search results may differ.")
    says = {"changed": "changed since indexing", "missing": "is missing", "unreadable": "could not be read"}
    out += [f"Warning: source '{p}' {says[w]}." for p, w in report.stale]
    if report.lexical_fallback:
        out.append("Warning: no lexical match for the query; using hybrid")
    return out


def summary(report: Report, path: str) -> str:
    return f"Indexed {report.chunks} chunks into '{path}'."
