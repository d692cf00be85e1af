import pytest
from pyspark.sql import functions as F

from siftlog.functions import query as Q
from siftlog.functions import text as T

# (text, template): one rule of the mask each.
MASKS = [
    ("took 15 ms", "took <*> ms"), ("-5 +6 a-5 x5", "<*> <*> a-<*> x5"), ("99 bottles", "<*> bottles"), ("x_1", "x_1"), ("a1b2", "a1b2"),
    ("/var/log/app", "/var/log/app"), ("/var/log/app2/x y", "<*> y"), ("/deface/x ok", "/deface/x ok"), ("a /x/1.log b", "a <*> b"), ("n/a", "n/a"), ("/", "/"),
    ("id 123e4567-e89b-12d3-a456-426614174000.", "id <*>."), ("x123e4567-e89b-12d3-a456-426614174000", "x<*>-e89b-12d3-a456-<*>"),
    ("blk_1blk_-2", "<*><*>"), ("myblk_1", "myblk_1"), ("blk_1abc", "blk_1abc"), ("blk_-70000000000000011 ok", "<*> ok"),
    ("from 10.0.0.1:8080 to 1.2.3.4", "from <*> to <*>"), ("1.2.3.4:99999", "<*>.<*>.<*>.<*>:<*>"), ("256.1.1.1", "<*>.<*>.<*>.<*>"), ("001.002.003.004", "<*>"),
    ("::1 up", "<*> up"), ("fe80::1%eth0", "<*>%eth0"), ("[2001:db8::1]:443 x", "<*> x"), ("[::1] x", "<*> x"), ("ab:cd:ef:ab:cd:ef:ab:cd", "<*>"), ("1:2:3:4:5:6:7:8", "<*>"), ("::ffff:1.2.3.4 x", "<*> x"), ("std::move", "std::move"),
    ("2024-01-02T03:04:05.123Z go", "<*> go"), ("2024-01-02 03:04:05,1", "<*>,<*>"), ("2024-01-02 03:04:05 +01:00", "<*> <*>:<*>"), ("2024-01-02T03:04:05+0100", "<*>"), ("2024-13-02", "<*>-<*>-<*>"), ("on 2024-01-02 x", "on <*> x"),
    ("Jan  2 03:04:05 host", "<*> host"), ("Jan 32 03:04:05", "Jan <*> <*>"), ("xJan 2 03:04:05", "xJan <*> <*>"), ("at 12:34:56 x", "at <*> x"), ("12:34:56.123456 x", "<*> x"), ("25:00:00", "<*>:<*>:<*>"),
    ("0xdeadbeef", "<*>"), ("0x12", "0x12"), ("deadbeef", "<*>"), ("xdecade", "x<*>"), ("abcde", "abcde"), ("decade facade", "<*> <*>"), ("", ""), ("plain words", "plain words"),
]


def test_mask_template(spark):
    rows = spark.createDataFrame([(i, pre + t + post, pre + m + post) for i, (t, m) in enumerate(MASKS) for pre, post in (("", ""), ("head ", ""), ("", " tail")) if t or not pre + post], "i int, t string, m string")
    wrong = rows.withColumn("got", T.mask_template(F.col("t"))).where("not got <=> m").collect()
    assert not wrong


def test_mask_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(T.mask_template(F.col("t"))).first()[0] is None


TERMS = [
    ("fooBar baz-Qux.v2", ["foo", "bar", "baz", "qux", "v2", "baz-qux.v2"]), ("ERR-5001 a__b::c", ["err", "5001", "a", "b", "c", "err-5001", "a__b::c"]), ("HTTPServer9 x9Y", ["httpserver9", "x9y"]),
    ("été Ünï", ["été", "Ünï"]), ("--- .", []), ("", []), ("a a A", ["a", "a", "a"]), ("1.2.3.4:80", ["1", "2", "3", "4", "80", "1.2.3.4:80"]), ("日本 語", ["日本", "語"]),
]


def test_lexical_terms(spark):
    rows = spark.createDataFrame(TERMS, "t string, want array<string>").withColumn("got", T.lexical_terms(F.col("t"))).collect()
    for r in rows:
        assert sorted(r.got) == sorted(r.want), r.t
        assert sorted(Q.lexical_terms(r.t)) == sorted(r.want), r.t


YES = ["123e4567-e89b-12d3-a456-426614174000", "deadbee1", "0xdeadbee1", "1234", "ERR-5001", "blk_-70000000000000013", "abc_x123", "10.0.0.1", "10.0.0.1:65535", "::1", "fe80::1", "[::1]:80", "/var/log", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4"]
NO = ["deadbeef", "123", "10.0.0.1:65536", "10.0.0.256", "1::2::3", "[::1]", "/var", "hello", "a/b/c", "::", "ERR-12", "", "x" * 11 + "-1234"]


@pytest.mark.parametrize("token", YES + NO)
def test_identifier_on_the_driver(token):
    assert Q.is_identifier(token) == (token in YES)


def test_identifier_column_agrees(spark):
    rows = spark.createDataFrame([(t,) for t in YES + NO], "t string").select("t", T.is_identifier(F.col("t")).alias("got")).collect()
    assert [r.t for r in rows if r.got != (r.t in YES)] == []


QUERIES = [("", "natural"), ("connection refused", "natural"), ("ERR-5001", "identifier"), ('"ERR-5001"', "identifier"), ("failed ERR-5001", "mixed"), ('"failed ERR-5001"', "mixed"), ('say "1234"', "mixed"), ("  1234 ", "identifier"), ("1234 5678", "mixed")]


def test_query_class(spark):
    rows = spark.createDataFrame(QUERIES, "q string, want string").withColumn("got", T.query_class(F.col("q"))).collect()
    for r in rows:
        assert r.got == r.want == Q.classify(r.q), r.q


def test_resolve():
    assert Q.resolve("auto", "identifier") == "lexical"
    assert Q.resolve("auto", "mixed") == Q.resolve("auto", "natural") == "hybrid"
    assert Q.resolve("dense", "identifier") == "dense"
    with pytest.raises(ValueError):
        Q.resolve("other", "natural")


def test_limit_counts_code_points(spark):
    r = spark.createDataFrame([("é" * 4097,), ("x" * 4096,)], "t string").select(T.limit_value(F.col("t")).alias("c")).collect()
    assert [(len(x.c.text), x.c.truncated) for x in r] == [(4096, True), (4096, False)]


def test_blank_is_ascii_only(spark):
    rows = [("", True), (" \t\r\f\x0b", True), (" ", False), ("x", False)]
    got = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", T.is_blank(F.col("t"))).collect()
    assert all(r.got == r.want for r in got)


def test_sql_functions(spark):
    T.register(spark)
    r = spark.sql("SELECT mask_template('took 15 ms') m, lexical_terms('fooBar') t, is_identifier('ERR-5001') i, dot(array(1D, 2D), array(3D, 4D)) d").first()
    assert (r.m, r.t, r.i, r.d) == ("took <*> ms", ["foo", "bar"], True, 11.0)


def test_code_points_that_mark_matches(spark):
    """Texts with the code points that the mask puts around matches keep them."""
    rows = ["a\ufdd0b 12", "ab 12", "\ufdd1 /usr/bin \ufdd2\ufdd3 7", "\ufdd0\ufdd1 3", "x\ufdd2 44"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    want = [r.replace("12", "<*>").replace("44", "<*>").replace(" 7", " <*>").replace(" 3", " <*>") for r in rows]
    assert [r[0] for r in df.select(T.mask_template(F.col("t"))).collect()] == want
    T.register(spark)
    df.createOrReplaceTempView("marked")
    assert [r[0] for r in spark.sql("SELECT mask_template(t) FROM marked").collect()] == want


def test_sql_functions_say_the_same(spark):
    T.register(spark)
    queries = ["", "error 404", '"12345"', "10.0.0.1", "deadbeef1", "ERR-5001\n", "plain words", "[::1]:80", '"two words"', "1234\n5678"]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    df.createOrReplaceTempView("asked")
    same = df.select(T.query_class(F.col("q")), T.is_identifier(F.col("q"))).collect()
    assert [tuple(r) for r in spark.sql("SELECT query_class(q), is_identifier(q) FROM asked").collect()] == [tuple(r) for r in same]
    assert spark.sql("SELECT dot(array(1D, 2D), array(3D, 4D)) AS d").first().d == 11.0
    assert spark.sql("SELECT dot(NULL, array(3D)) AS d").first().d is None
    with pytest.raises(Exception, match="same width"):
        spark.sql("SELECT dot(array(1D), array(3D, 4D)) AS d").collect()
