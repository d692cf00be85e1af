import gzip
import io
import json
import os
import pickle
import tarfile
import zipfile

import pytest

from siftlog import cli, render
from siftlog.embed import HashEmbedder
from siftlog.errors import EngineError, Report
from siftlog.plans.index import Index, build, check_lexical, check_policy, policy
from siftlog.plans.search import LogSearch, search
from siftlog.sources.decode import Limits, read_record, records
from siftlog.sources.expand import expand, kind_of
from siftlog.sources.scan import _Reader, _tasks, scan


def shown(rs):
    return [(r.line_number, r.text, r.skip_reason) for r in rs]


def test_lines():
    got = shown(records("a.log", b"one\r\n\n  \ntwo\rstill two\nlast"))
    assert got == [(1, "one", None), (2, None, "empty"), (3, None, "empty"), (4, "two\rstill two", None), (5, "last", None)]
    assert shown(records("a.log", b"")) == []


def test_line_limit():
    (r,) = records("a.log", ("é" * 5000).encode())
    assert len(r.text) == 4096 and r.truncated


def test_json_lines():
    data = b'{"message": "a"}\n{"message": 5}\n{bad\n\n{"other": "x"}\n[1]\n{"message": " "}\n{"message": "b"} x\n{"message": "c", "message": "d"}\n'
    assert [r.skip_reason or r.text for r in records("a.jsonl", data)] == ["a", "missing_field", "malformed", "empty", "missing_field", "missing_field", "empty", "malformed", "d"]


def test_json_document():
    assert shown(records("a.json", b'{"message": "x"}')) == [(1, "x", None)]
    got = list(records("a.json", b'[{"message": ""}, {"other": "y"}, {"message": "keep"}]'))
    assert [(r.line_number, r.array_element, r.text) for r in got] == [(1, True, None), (2, True, None), (3, True, "keep")]
    assert shown(records("a.json", b"{")) == [(1, None, "malformed")]
    assert shown(records("a.json", b"5")) == [(1, None, "missing_field")]


def test_gzip():
    data = gzip.compress(b"one\n") + gzip.compress(b"two\n")
    assert [r.text for r in records("a.LOG.GZ", data)] == ["one", "two"]
    assert kind_of("a.jsonl.gz") == "jsonl"
    with pytest.raises(EngineError, match="gzip stream"):
        list(records("a.gz", data[:-4]))


def test_binary_and_encrypted():
    with pytest.raises(EngineError, match="binary"):
        list(records("a.log", b"x\0y"))
    with pytest.raises(EngineError, match="encrypted"):
        list(records("a.log", b"-----BEGIN PGP MESSAGE-----\n"))


def test_read_record_again(tmp_path):
    for name, data in (("a.log", b"one\r\n\ntwo\n"), ("a.json", b'[{"message": "x"}, {"message": "y"}]'), ("a.jsonl", b'{"message": "x"}\n{"message": "y"}\n'), ("b.log.gz", gzip.compress(b"one\ntwo\n"))):
        path = str(tmp_path / name)
        (tmp_path / name).write_bytes(data)
        for r in records(path, data):
            if r.text:
                assert read_record(path, r) == r.text
    with pytest.raises(EngineError):
        read_record("-", r)


def tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_tar_members():
    skipped = {}
    data = tar([("./b.log", b"bee\n"), ("d/", None), ("a.jsonl", b'{"message": "ay"}'), ("bin", b"\0"), ("c.log.gz", gzip.compress(b"sea"))])
    got = [(r.source, r.text) for r in records("x.tgz", data, skipped=skipped)]
    assert got == [("x.tgz:b.log", "bee"), ("x.tgz:a.jsonl", "ay"), ("x.tgz:c.log.gz", "sea")]
    assert skipped == {"directories": 1, "binary": 1}
    with pytest.raises(EngineError, match="archive is truncated"):
        list(records("x.tgz", data[: len(data) // 2]))


def test_zip_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("z.log", "zed\n")
        z.writestr("dir/", "")
        z.writestr("a\\b.log", "bee\n")
    skipped = {}
    assert [(r.source, r.text) for r in records("x.zip", out.getvalue(), skipped=skipped)] == [("x.zip:z.log", "zed"), ("x.zip:a/b.log", "bee")]
    assert skipped == {"directories": 1}


@pytest.mark.parametrize("limits, words", [(Limits(entry_bytes=3), "larger than 3"), (Limits(total_bytes=6), "past 6"), (Limits(entries=1), "exceeds 1"), (Limits(ratio=2), "ratio exceeds 2")])
def test_archive_limits(limits, words):
    data = tar([("a.log", b"four" + b"x" * (2 << 20) * (limits.ratio == 2)), ("b.log", b"five\n")])
    with pytest.raises(EngineError, match=words):
        list(records("x.tgz", data, limits=limits))


def test_expand(tmp_path):
    for n in ("b.log", "B.log", ".hidden", "_x", "sub/a.log"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    os.symlink(tmp_path / "b.log", tmp_path / "link")
    os.symlink(tmp_path / "sub", tmp_path / "linked")
    names = [os.path.relpath(p, tmp_path) for p in expand([str(tmp_path)])]
    assert names == [".hidden", "B.log", "_x", "b.log", "link", "sub/a.log"]
    assert expand(["-", str(tmp_path / "b.log")]) == ["-", str(tmp_path / "b.log")]
    with pytest.raises(EngineError):
        expand([str(tmp_path / "none")])
    os.symlink(tmp_path / "gone", tmp_path / "dangling")
    with pytest.raises(EngineError):
        expand([str(tmp_path)])


def test_scan_in_order(spark, tmp_path):
    (tmp_path / "b.log").write_text("two\n\nthree\n")
    (tmp_path / "a.json").write_text('[{"message": "one"}]')
    rows = scan(spark, str(tmp_path)).orderBy("source_index", "line_number").collect()
    assert [(r.source_index, r.line_number, r.text) for r in rows] == [(0, 1, "one"), (1, 1, "two"), (1, 2, None), (1, 3, "three")]


def test_scan_through_spark(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    assert [r.text for r in scan(spark, f"file://{tmp_path}/a.log").orderBy("line_number").collect()] == ["x", "y"]


def test_scan_splits_files(spark, tmp_path):
    """A file in ranges and through Spark's reader in blocks: the records of the file as a whole, with their places."""
    n = 3000
    raw = "".join(f"line {i}\r\n" if i % 7 else "\n" for i in range(1, n + 1)).encode() + b"caf\xc3\xa9 \xff last"
    (tmp_path / "big.log").write_bytes(raw)
    (tmp_path / "big.jsonl").write_text("".join('{"message": "m%d"}\n' % i if i % 5 else "{\n" for i in range(n)))
    (tmp_path / "empty.log").write_text("")
    paths = [str(tmp_path / x) for x in ("big.log", "empty.log", "big.jsonl")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    plain = lambda x: [tuple("" if c is None else c for c in r) for r in x]
    try:
        whole = sorted(plain(tuple(r)[2:] for r in scan(spark, *paths).collect()))
        assert len(whole) == 2 * n + 1 and whole[-1] != whole[0]
        for size in (1000, 4096):
            assert sorted(plain(tuple(r)[2:] for r in scan(spark, *paths, range_bytes=size).collect())) == whole
        stored = scan(spark, *[f"file://{p}" for p in paths])
        assert stored.rdd.getNumPartitions() > 2
        assert sorted(plain(tuple(r)[2:] for r in stored.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    tiny = tmp_path / "tiny.log"
    tiny.write_text("a\n\nbb\nccc")
    for size in (1, 2, 3, 4):
        got = [(r.line_number, r.byte_offset, r.text) for r in scan(spark, str(tiny), range_bytes=size).orderBy("line_number").collect()]
        assert got == [(1, 0, "a"), (2, 2, None), (3, 3, "bb"), (4, 6, "ccc")]


def test_many_ranges_are_few_tasks(spark, tmp_path):
    """A task for each range, with a list of all ranges in each, took time with the square of the number of files."""
    for i in range(300):
        (tmp_path / f"{i:03}.log").write_text("".join(f"file {i} line {j}\n" for j in range(40)))
    got = scan(spark, str(tmp_path), range_bytes=100)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism + 1
    rows = [(r.source_index, r.line_number, r.text) for r in got.collect()]
    assert rows == [(i, j + 1, f"file {i} line {j}") for i in range(300) for j in range(40)]
    parts = [[i, f"p{i}", 0, 10, 1] for i in range(1000)]
    reader = _Reader(parts, {"cores": "4"})
    assert [x for p in reader.partitions() for x in p.parts] == parts and 4 <= len(reader.partitions()) <= 5
    assert len(pickle.dumps(reader)) < 500
    big = [[0, "a", 0, 40 << 20, 1], [0, "a", 40 << 20, 41 << 20, 9], [1, "b", 0, 5, None]]
    assert [len(p.parts) for p in _tasks(big, 1)] == [1, 2]


def test_store_folders_and_probes(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "b.log").write_text("two\n")
    (tmp_path / "d" / "e" / "a.json").write_text('[{"message": "one"}]')
    with gzip.open(tmp_path / "d" / "c.log.gz", "wt") as f:
        f.write("three\n")
    got = [(r.source_index, r.source.rsplit("/", 1)[1], r.text) for r in scan(spark, f"file://{tmp_path}/d").orderBy("source_index").collect()]
    assert got == [(0, "b.log", "two"), (1, "c.log.gz", "three"), (2, "a.json", "one")]
    (tmp_path / "bin.log").write_bytes(b"x\n" * 100 + b"\0\n")
    for path in (str(tmp_path / "bin.log"), f"file://{tmp_path}/bin.log"):
        with pytest.raises(Exception, match="binary"):
            scan(spark, path).collect()
    with pytest.raises(EngineError):
        scan(spark, f"file://{tmp_path}/none.log")


BLOCKS = "worker 1 lets go of blk_70000000000000011 now\nworker 0 lets go of blk_-70000000000000012 now\n\nquiet garden evening\n"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "blocks.log").write_text(BLOCKS)
    report = build(spark, [str(d / "blocks.log")], str(d / "idx"), HashEmbedder())
    return d, report


def test_index_and_search(spark, corpus):
    d, report = corpus
    assert (report.chunks, report.empty) == (3, 1)
    got = LogSearch(spark, HashEmbedder()).search("blk_-70000000000000012", str(d / "idx"))
    rows = got.matches.collect()
    assert got.report.mode == "lexical" and rows[0].line == 2 and rows[0].dense is None and rows[0].lexical is not None
    hybrid = search(Index.open(spark, str(d / "idx")), "garden evening", HashEmbedder(), k=1).matches.collect()
    assert (hybrid[0].line, hybrid[0].rank, hybrid[0].mode) == (4, 1, "hybrid")


def test_group_takes_the_first_line(spark, corpus):
    d, _ = corpus
    rows = LogSearch(spark, HashEmbedder()).search("blk_-70000000000000012", str(d / "idx"), group=True).matches.collect()
    assert [(r.line, r.occurrences) for r in rows] == [(1, 2)]


def test_dense_has_no_lexical_and_k_counts(spark, corpus):
    d, _ = corpus
    rows = LogSearch(spark, HashEmbedder()).search("garden", str(d / "idx"), mode="dense", k=2).matches.collect()
    assert len(rows) == 2 and rows[0].line == 4 and all(r.lexical is None for r in rows)


def test_fallback(spark, corpus):
    d, _ = corpus
    got = LogSearch(spark, HashEmbedder()).search("ERR-5001", str(d / "idx"))
    assert got.report.lexical_fallback and got.matches.first().mode == "hybrid"


def test_grep_equals_search_without_blank_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("alpha beta\nbeta gamma\nalpha 12 delta\nalpha 13 delta\n")
    e = LogSearch(spark, HashEmbedder())
    e.index(str(tmp_path / "idx"), str(tmp_path / "a.log"))
    for mode in ("hybrid", "lexical", "dense"):
        for group in (False, True):
            a = e.grep("alpha delta", str(tmp_path / "a.log"), mode=mode, group=group).matches.collect()
            assert a == e.search("alpha delta", str(tmp_path / "idx"), mode=mode, group=group).matches.collect()


def test_policy_and_staleness(spark, corpus):
    d, _ = corpus
    index = Index.open(spark, str(d / "idx"))
    assert check_policy(index.policy, policy(HashEmbedder())) is False
    assert check_policy(index.policy | {"mask": "other"}, policy(HashEmbedder())) is True
    with pytest.raises(EngineError, match="different model"):
        check_policy(index.policy, policy(HashEmbedder(64)))
    with pytest.raises(EngineError, match="not supported"):
        check_policy(index.policy | {"format": "9"}, policy(HashEmbedder()))
    check_lexical({}, "dense")
    with pytest.raises(EngineError, match="no lexical postings"):
        check_lexical({}, "hybrid")
    assert index.stale() == []
    path = d / "blocks.log"
    os.utime(path, (1, 1))
    assert index.stale() == [(str(path), "changed")]


def test_index_refusals(spark, tmp_path):
    (tmp_path / "empty.log").write_text("\n\n")
    with pytest.raises(EngineError) as e:
        build(spark, [str(tmp_path / "empty.log")], str(tmp_path / "idx"), HashEmbedder())
    assert e.value.exit_code == 1 and e.value.cause == "nothing_indexable" and not (tmp_path / "idx").exists()
    assert os.listdir(tmp_path) == ["empty.log"]
    with pytest.raises(EngineError, match="one of the inputs"):
        build(spark, [str(tmp_path / "empty.log")], str(tmp_path / "empty.log"), HashEmbedder())
    with pytest.raises(EngineError):
        Index.open(spark, str(tmp_path / "nowhere"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text(BLOCKS)
    run = lambda *a: cli.run(cli.parser().parse_args([*map(str, a)]), spark, HashEmbedder())
    assert run("grep", "garden", tmp_path / "a.log", "-k", 1, "--json") == 0
    out = capsys.readouterr()
    row = json.loads(out.out)
    assert list(row) == ["schema_version", "rank", "source", "kind", "line", "score", "text", "occurrences", "mode", "dense", "lexical"] and row["line"] == 4
    assert out.err == "Skipped 1 empty line.\n"
    assert run("grep", "x", tmp_path / "none") == 2
    (tmp_path / "e.log").write_text("\n")
    assert run("grep", "x", tmp_path / "e.log") == 1


def test_render():
    assert render.escape("a\x1b[2J\x07\x7fé\u0085") == "a\\x1B[2J\\x07\\x7Fé\\u0085"
    assert render.escape(b"a\xff") == "a\\xFF"
    assert [render.shortest(x) for x in (0.1, 1.0, 0.0, None, 1e-5, 2.5315044, 1e10, 123456.0, -0.25)] == ["0.1", "1", "0", "null", "1e-05", "2.5315044", "1e+10", "123456", "-0.25"]
    r = {"source": "x:a.log", "kind": "line", "line": 3, "score": 0.5, "text": "t", "occurrences": 2}
    assert render.text_line(r, Report()) == "x:a.log:line 3: 0.5000: t"
    assert render.text_line(r | {"source": "a.log"}, Report(grouped=True)) == "line 3 (2): 0.5000: t"
    assert render.messages(Report(empty=2, malformed=1, missing_field=2, truncated=1)) == ['Skipped 2 empty lines, 1 malformed line, and 2 lines missing the "message" field.', "Truncated 1 line."]
    assert render.bundle_message("x.tar", {"directories": 1, "binary": 2}) == "Skipped 3 entries in 'x.tar' (1 directory and 2 binary files)."


def test_errors():
    import pickle

    e = EngineError("parse", "file_open", "x")
    assert e.message() == "Error: failed to parse 'x': could not open the file" and e.exit_code == 2
    assert pickle.loads(pickle.dumps(e)).cause == "file_open"
    assert EngineError("empty_input", "empty_file", "x").message() == "nothing to search in 'x': the file is empty"
