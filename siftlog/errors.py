"""One exception for everything that can go wrong, with a kind (what was being done) and a cause (why it failed)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Kinds, causes and their sentences.
KINDS = ("embedder_load", "parse", "embed", "query_embed", "index_build", "search", "empty_input", "no_matches", "corpus_read", "corpus_write", "corpus_load")
CAUSES = {
    "none": "",
    "file_open": "could not open the file",
    "unsupported_format": "unsupported format",
    "binary_file": "the file is binary",
    "corrupt_gzip": "the gzip stream is truncated or corrupt",
    "corrupt_archive": "the archive is truncated or corrupt",
    "encrypted_archive": "the archive is encrypted; decrypt it first",
    "archive_limit": "an archive limit was exceeded",
    "vocab_load": "could not load the vocabulary",
    "tokenization": "could not tokenize the text",
    "model_load": "could not load the model",
    "inference": "inference failed",
    "invalid_input": "the input is invalid",
    "mismatched_dimensions": "the embedding width does not match",
    "empty_embedding": "the embedding is empty",
    "corrupt_file": "the file is corrupt",
    "unsupported_version": "the corpus format is not supported; build the index again",
    "model_mismatch": "the corpus was built with a different model; build the index again",
    "source_changed": "the source changed while indexing; retry",
    "empty_file": "the file is empty",
    "nothing_indexable": "no indexable lines",
    "empty_corpus": "the corpus is empty",
    "output_is_input": "the output is one of the inputs",
    "no_postings": "the corpus has no lexical postings; build the index again",
    "terms_mismatch": "the corpus has lexical terms of another version; build the index again",
}
_DOING = {
    "embedder_load": "failed to load the embedder from '{path}'", "parse": "failed to parse '{path}'", "embed": "failed to embed the input", "query_embed": "failed to embed the query",
    "index_build": "failed to build the index", "search": "failed to search", "corpus_read": "failed to read the corpus '{path}'", "corpus_write": "failed to write the corpus '{path}'", "corpus_load": "failed to load the corpus",
}


class EngineError(Exception):
    def __init__(self, kind: str, cause: str = "none", path: str = "", note: str = "", report: Report | None = None):
        if kind not in KINDS or cause not in CAUSES:
            raise ValueError(f"unknown kind or cause: {kind}, {cause}")
        self.kind, self.cause, self.path, self.note, self.report = kind, cause, path, note, report
        super().__init__(self.message())

    def message(self) -> str:
        reason = self.note if self.kind == "parse" and self.note else CAUSES[self.cause]
        if self.kind == "no_matches":
            return ""
        if self.kind == "empty_input":
            where = f" in '{self.path}'" if self.path else ""
            if not self.note:
                return f"nothing to search{where}: {reason}"
            return f"no indexable lines{where}: {reason}; {self.note}" if self.cause == "empty_file" else f"no indexable lines{where}; {self.note}"
        text = f"Error: {_DOING[self.kind].format(path=self.path)}: {reason}"
        return f"{text}. {self.note}" if self.kind == "embedder_load" and self.note else text

    @property
    def exit_code(self) -> int:
        return 1 if self.kind in ("empty_input", "no_matches") else 2

    def __reduce__(self):
        return EngineError, (self.kind, self.cause, self.path, self.note, self.report)


def from_worker(e: Exception) -> str | None:
    """The message of an EngineError that a Python worker raised: Spark passes it on as text."""
    found = re.findall(r"siftlog\.errors\.EngineError: (.*)", str(e))
    return found[-1] if found else None


@dataclass
class Report:
    """What a command has to say beside its rows."""

    chunks: int = 0
    empty: int = 0
    malformed: int = 0
    missing_field: int = 0
    truncated: int = 0
    json_field: str = "message"
    multiple_sources: bool = False
    grouped: bool = False
    mode: str = ""
    query_class: str = ""
    lexical_fallback: bool = False
    policy_mismatch: bool = False
    stale: list[tuple[str, str]] = field(default_factory=list)  # (source, changed | missing | unreadable)
    bundles: dict[str, dict[str, int]] = field(default_factory=dict)  # archive -> skipped entries by kind
    seconds: dict[str, float] = field(default_factory=dict)  # by stage
    peak_mb: float = 0.0  # of the driver's Python
