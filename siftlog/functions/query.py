"""The query, classified on the driver: tokens, class, mode."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

from siftlog.functions.text import LOWER, UPPER

MODES = ("auto", "hybrid", "dense", "lexical")
_PORT = re.compile(r"[0-9]+")
# The shapes of identifiers.
_SHAPES = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:0[xX])?(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{8,}|[0-9]{4,}|[A-Za-z]{2,10}[-_]-?[A-Za-z]?[0-9]{3,}|(?:/[^/\s]+){2,}/?")
_RUN = re.compile(r"(?:[A-Za-z0-9]|[^\x00-\x7F])+")
_COMPOUND = re.compile(rf"{_RUN.pattern}(?:[-_.:]+{_RUN.pattern})+")


def _port(text: str) -> bool:
    return bool(_PORT.fullmatch(text)) and int(text) <= 65535


def _ipv4(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)


def _ipv6(text: str) -> bool:
    try:
        return "%" not in text and text != "::" and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def is_identifier(token: str) -> bool:
    """A UUID, a hex run of 8 or more with a digit, 4 or more digits, LETTERS-123, an IP address with or without a port, or an absolute path of two or more parts."""
    if _SHAPES.fullmatch(token):
        return True
    host, colon, port = token.rpartition(":")
    if _ipv4(token) or (colon and _ipv4(host) and _port(port)) or _ipv6(token):
        return True
    return host.startswith("[") and host.endswith("]") and _ipv6(host[1:-1]) and _port(port)


def unquote(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] == '"' else text


def tokens(query: str) -> list[str]:
    return [t for t in (unquote(x) for x in re.split(r"[\t\n\r ]+", unquote(query))) if t]


def classify(query: str) -> str:
    found = tokens(query)
    if not any(map(is_identifier, found)):
        return "natural"
    return "identifier" if len(found) == 1 else "mixed"


def resolve(mode: str, query_class: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return mode if mode != "auto" else "lexical" if query_class == "identifier" else "hybrid"


def lexical_terms(text: str) -> list[str]:
    """The same terms as functions.text.lexical_terms, for a query."""
    parts = _RUN.findall(re.sub("([a-z])([A-Z])", r"\1 \2", text)) + _COMPOUND.findall(text)
    return [p.translate(str.maketrans(UPPER, LOWER)) for p in parts]


@dataclass(frozen=True)
class Query:
    raw: str
    stripped: str
    query_class: str
    mode: str
    terms: tuple[str, ...]  # distinct, in the order of their bytes

    @classmethod
    def of(cls, text: str, mode: str = "auto") -> Query:
        kind, stripped = classify(text), unquote(text)
        return cls(text, stripped, kind, resolve(mode, kind), tuple(sorted(set(lexical_terms(stripped)), key=str.encode)))
