"""One thin query opN_<name> for each operator, over whole tables, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm import bpe, chroma, feistel, gracehash, langid, linkgraph, mixing, records, rindex, setsketch
from siftlog.session import ship


def tokenizer_path(name: str) -> str:
    """Vocabulary files lie outside the repository; SIFTLOG_TOKENIZERS names their folder, the installed package is the default."""
    own = os.environ.get("SIFTLOG_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chroma(spark, sf_dir):
    """No table has an audio column: each text's UTF-8 bytes, played as unsigned 8-bit samples at 11,025 Hz, stand in for one.

    Frames are short, since texts make recordings of a second or less; the operator's defaults are for music.
    """
    settings = chroma.Settings(rate=11025, frame=256, hop=32, low=300.0, high=3520.0)
    return chroma.recordings(documents(spark, sf_dir), F.col("text").cast("binary"), settings)


def op2_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_rindex(spark, sf_dir):
    out = rindex.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark, sf_dir):
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op5_setsketch(spark, sf_dir):
    return setsketch.near_duplicates(documents(spark, sf_dir), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_langid(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


#: (verdict, host/path); the longest rule that fits decides.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_linkgraph(spark, sf_dir):
    ship(spark)
    return linkgraph.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op8_records(spark, sf_dir):
    out = records.token_records(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def op9_gracehash(spark, sf_dir):
    return gracehash.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_feistel(spark, sf_dir):
    """The key is a constant here so that reruns agree; a real run takes it from a secret store."""
    out = feistel.pseudonymize(documents(spark, sf_dir), key="siftlog test key")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", F.size("found").cast("long").alias("n_replaced"), *map(count, feistel.KINDS), "text")


SQL = {
    "op7_linkgraph": linkgraph.oracle(RULES),
    "op2_mixing": mixing.RESULT_SQL,
    "op9_gracehash": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}

QUERIES = {f.__name__: f for f in (op1_chroma, op2_mixing, op3_rindex, op4_bpe, op5_setsketch, op6_langid, op7_linkgraph, op8_records, op9_gracehash, op10_feistel)}
