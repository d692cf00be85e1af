"""python -m siftlog.cli grep|index|search: exit code 0 for results, 1 for nothing to rank, 2 for errors."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException

from siftlog import __version__, render
from siftlog.errors import EngineError, from_worker


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def threads(text: str) -> int:
    n = positive(text)
    if n > 1024:
        raise argparse.ArgumentTypeError("must be at most 1024")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftlog")
    top.add_argument("--version", action="version", version=__version__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("grep", "index", "search"):
        p = verbs.add_parser(verb)
        p.add_argument("--threads", type=threads, default=int(os.environ.get("SIFTLOG_THREADS", 0)) or None)
        p.add_argument("--model-dir")
        p.add_argument("--verbose", action="store_true")
        if verb != "index":
            p.add_argument("query")
            p.add_argument("-k", "--top-k", type=positive, default=5)
            p.add_argument("--mode", choices=("auto", "hybrid", "dense", "lexical"), default="auto")
            p.add_argument("--group", action="store_true")
            p.add_argument("--json", action="store_true")
        if verb != "search":
            p.add_argument("files", nargs="+")
            p.add_argument("--json-field", default="message")
            p.add_argument("--quiet", action="store_true")
            for name in ("entry-bytes", "bytes", "entries", "ratio"):
                p.add_argument(f"--archive-max-{name}", type=positive)
        if verb == "index":
            p.add_argument("-o", "--output", required=True)
        if verb == "search":
            p.add_argument("-i", "--index", required=True)
    return top


def limits_of(args):
    from siftlog.sources.decode import Limits

    named = {"entry_bytes": args.archive_max_entry_bytes, "total_bytes": args.archive_max_bytes, "entries": args.archive_max_entries, "ratio": args.archive_max_ratio}
    return Limits(**{k: v for k, v in named.items() if v})


def session(n: int | None, quiet: bool):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{n or '*'}]").appName("siftlog").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(not quiet and sys.stderr.isatty()).lower()).config("spark.sql.shuffle.partitions", str(n or os.cpu_count() or 8)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args, spark=None, embedder=None) -> int:
    from siftlog.embed import HashEmbedder, OnnxEmbedder, find_model
    from siftlog.plans.search import LogSearch

    spark = spark or session(args.threads, getattr(args, "quiet", True))
    try:
        if embedder is None:
            try:
                embedder = OnnxEmbedder(find_model(args.model_dir))
            except EngineError:
                if args.model_dir:
                    raise
                embedder = HashEmbedder()  # no model is installed
        engine = LogSearch(spark, embedder)
        if args.verb == "index":
            report = engine.index(args.output, *args.files, json_field=args.json_field, limits=limits_of(args))
            print(*render.messages(report), render.summary(report, args.output), sep="\n", file=sys.stderr)
            return 0
        how = {"k": args.top_k, "mode": args.mode, "group": args.group}
        found = engine.grep(args.query, *args.files, json_field=args.json_field, limits=limits_of(args), **how) if args.verb == "grep" else engine.search(args.query, args.index, **how)
        rows = found.matches.collect()
        for m in render.messages(found.report):
            print(m, file=sys.stderr)
        if args.verbose:
            for stage, s in found.report.seconds.items():
                print(f"{stage}: {s:.3f} s", file=sys.stderr)
            print(f"peak memory: {found.report.peak_mb:.0f} MB", file=sys.stderr)
        for r in rows:
            print(render.json_line(r) if args.json else render.text_line(r, found.report))
        return 0 if rows else 1
    except EngineError as e:
        for m in [e.message(), *(render.messages(e.report) if e.report else [])]:
            if m:
                print(m, file=sys.stderr)
        return e.exit_code
    except PySparkException as e:
        message = from_worker(e)
        if message is None:
            raise
        print(message, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run(parser().parse_args()))
