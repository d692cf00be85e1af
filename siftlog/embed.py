"""Embedders: from a table of texts to a table of vectors. Only distinct texts come here, so cost follows templates, not lines."""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.errors import EngineError
from siftlog.functions.query import lexical_terms as terms_of
from siftlog.functions.text import lexical_terms


class Embedder(Protocol):
    def identity(self) -> dict[str, str]:
        """model.id, model.sha256, model.quantization, vocab.sha256 and dimensions."""

    def vectors(self, texts: DataFrame) -> DataFrame:
        """distinct_id, vector (array of float) for texts (distinct_id, text)."""

    def query(self, text: str) -> list[float]:
        """The vector of one text, on the driver."""


class HashEmbedder:
    """Counts of terms, hashed to `dimensions` buckets, to unit length. No model, no Python on the executors, the same on every engine that has MD5."""

    def __init__(self, dimensions: int = 32):
        self.dimensions = dimensions

    def identity(self):
        return {"model.id": "term-hash-1", "model.sha256": hashlib.sha256(b"term-hash-1").hexdigest(), "model.quantization": "fp32", "vocab.sha256": "", "dimensions": str(self.dimensions)}

    def column(self, text: Column) -> Column:
        """counts of terms by bucket, over their length; all zero for a text without terms."""
        buckets = F.transform(lexical_terms(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % self.dimensions)
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))

    def vectors(self, texts):
        return texts.select("distinct_id", self.column(F.col("text")).alias("vector"))

    def query(self, text):
        counts = np.zeros(self.dimensions)
        for t in terms_of(text):
            counts[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % self.dimensions] += 1
        norm = np.sqrt((counts * counts).sum())
        return [float(np.float32(x / norm)) if norm > 0 else 0.0 for x in counts]


class ColumnEmbedder:
    """Vectors worked out elsewhere: a table (distinct_id, vector), and a dictionary of query vectors."""

    def __init__(self, table: DataFrame, queries: dict[str, list[float]], model_id: str = "given"):
        self.table, self.queries, self.model_id = table, queries, model_id
        self.dimensions = len(next(iter(queries.values()), []))

    def identity(self):
        return {"model.id": self.model_id, "model.sha256": "", "model.quantization": "fp32", "vocab.sha256": "", "dimensions": str(self.dimensions)}

    def vectors(self, texts):
        return texts.select("distinct_id").join(self.table, "distinct_id")

    def query(self, text):
        if text not in self.queries:
            raise EngineError("query_embed", "invalid_input")
        return self.queries[text]


class WordPiece:
    """BERT's tokenizer, uncased: clean, space CJK, lower-case, strip accents, split punctuation, then the longest known pieces."""

    def __init__(self, vocabulary: str, limit: int = 256):
        with open(vocabulary, encoding="utf-8") as f:
            self.ids = {line.rstrip("\r\n"): i for i, line in enumerate(f)}
        missing = [t for t in ("[CLS]", "[SEP]", "[UNK]") if t not in self.ids]
        if missing:
            raise EngineError("embedder_load", "vocab_load", vocabulary, f"missing {missing[0]}")
        self.limit = limit

    @staticmethod
    def _cjk(c: str) -> bool:
        # The blocks of CJK ideographs.
        p = ord(c)
        return 0x4E00 <= p <= 0x9FFF or 0x3400 <= p <= 0x4DBF or 0x20000 <= p <= 0x2A6DF or 0x2A700 <= p <= 0x2B73F or 0x2B740 <= p <= 0x2B81F or 0x2B820 <= p <= 0x2CEAF or 0xF900 <= p <= 0xFAFF or 0x2F800 <= p <= 0x2FA1F

    @staticmethod
    def _punctuation(c: str) -> bool:
        return (not c.isalnum() and 33 <= ord(c) <= 126) or unicodedata.category(c).startswith("P")

    def words(self, text: str) -> list[str]:
        out, word = [], []
        for c in text:
            kind = unicodedata.category(c)
            if c in "\t\n\r" or kind == "Zs":
                c = " "
            elif c in "\0�" or kind.startswith("C"):
                continue
            for d in unicodedata.normalize("NFD", c.lower()):
                if unicodedata.category(d) == "Mn":
                    continue
                if d == " " or self._cjk(d) or self._punctuation(d):
                    if word:
                        out.append("".join(word))
                        word = []
                    if d != " ":
                        out.append(d)
                else:
                    word.append(d)
        return [*out, "".join(word)] if word else out

    def pieces(self, word: str) -> list[int]:
        if len(word) > 100:
            return [self.ids["[UNK]"]]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                found = self.ids.get(("##" if at else "") + word[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return [self.ids["[UNK]"]]
        return out

    def encode(self, text: str) -> list[int]:
        ids = [self.ids["[CLS]"], *[i for w in self.words(text) for i in self.pieces(w)]][: self.limit - 1]
        return [*ids, self.ids["[SEP]"]]


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that count, to unit length where there is any."""
    m = mask[:, :, None].astype(np.float32)
    mean = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return np.where(norm > 0, mean / np.maximum(norm, 1e-30), mean).astype(np.float32)


# A window of texts is ordered by length, then cut by texts and by padded tokens.
WINDOW, MOST_TEXTS, MOST_TOKENS = 1024, 32, 1024


def batch_plan(lengths: list[int]) -> list[list[int]]:
    """Batches of positions: within each window shorter texts first, ties in input order."""
    out = []
    for a in range(0, len(lengths), WINDOW):
        batch: list[int] = []
        for i in sorted(range(a, min(a + WINDOW, len(lengths))), key=lambda i: lengths[i]):
            if batch and (len(batch) == MOST_TEXTS or (len(batch) + 1) * lengths[i] > MOST_TOKENS):
                out.append(batch)
                batch = []
            batch.append(i)
        out.append(batch)
    return out


def find_model(model_dir: str | None = None) -> str:
    """The first of: the argument, SIFTLOG_MODEL_DIR, the user's data folder, models/ beside the package, that has a model."""
    data = os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share")
    places = [model_dir] if model_dir else [os.environ.get("SIFTLOG_MODEL_DIR"), os.path.join(data, "siftlog", "models"), os.path.join(os.path.dirname(__file__), "models")]
    for p in places:
        if p and os.path.isfile(os.path.join(p, "vocab.txt")) and any(os.path.isfile(os.path.join(p, m)) for m in ("model_int8.onnx", "model.onnx")):
            return p
    raise EngineError("embedder_load", "file_open", places[0] or "", "No model was found.")


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class OnnxEmbedder:
    """A sentence encoder in ONNX format with WordPiece, in an iterator Pandas UDF: each Python worker loads it once. One thread for each task."""

    def __init__(self, model_dir: str | None = None, limit: int = 256):
        self.dir, self.limit = find_model(model_dir), limit
        name = next(m for m in ("model_int8.onnx", "model.onnx") if os.path.isfile(os.path.join(self.dir, m)))
        self.model, self.vocabulary, self.quantized = os.path.join(self.dir, name), os.path.join(self.dir, "vocab.txt"), name == "model_int8.onnx"
        self._run = None

    def identity(self):
        return {"model.id": os.path.basename(self.dir), "model.sha256": _sha256(self.model), "model.quantization": "int8" if self.quantized else "fp32", "vocab.sha256": _sha256(self.vocabulary), "dimensions": str(len(self.query("a")))}

    def runner(self):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        try:
            session = ort.InferenceSession(self.model, options, providers=["CPUExecutionProvider"])
        except Exception as e:
            raise EngineError("embedder_load", "model_load", self.model, str(e)) from e
        pieces, wanted = WordPiece(self.vocabulary, self.limit), {i.name for i in session.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            ids = [pieces.encode(t) for t in texts]
            out: list = [None] * len(texts)
            for batch in batch_plan([len(x) for x in ids]):
                width = max(len(ids[i]) for i in batch)
                tokens, mask = np.zeros((len(batch), width), np.int64), np.zeros((len(batch), width), np.int64)
                for r, i in enumerate(batch):
                    tokens[r, : len(ids[i])], mask[r, : len(ids[i])] = ids[i], 1
                feed = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
                states = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
                for r, i in enumerate(batch):
                    out[i] = mean_pool(states[r : r + 1], mask[r : r + 1])[0]
            return np.stack(out) if out else np.zeros((0, 0), np.float32)

        return run

    def vectors(self, texts):
        own = OnnxEmbedder.__new__(OnnxEmbedder)
        own.__dict__.update(self.__dict__ | {"_run": None})

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = own.runner()
            for s in parts:
                yield pd.Series(list(run(s.tolist())))

        return texts.select("distinct_id", embed("text").alias("vector"))

    def query(self, text):
        self._run = self._run or self.runner()
        return [float(x) for x in self._run([text])[0]]
