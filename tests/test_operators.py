import math
import random

import pytest
from pyspark.sql import functions as F

from siftlog.embed import HashEmbedder, WordPiece, batch_plan, mean_pool
from siftlog.functions import vectors as V
from siftlog.operators import bm25, dedup, fusion, metrics, ranking


def lines(spark, texts):
    return spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(texts)], "source_index long, line_number long, text string")


def by_hand(texts, terms):
    """BM25 in plain Python."""
    from siftlog.functions.query import lexical_terms

    docs = [lexical_terms(t) for t in texts]
    n, average = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in terms}
    out = []
    for d in docs:
        score = 0.0
        for t in terms:
            if tf := d.count(t):
                score += math.log(1.0 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (len(d) / average)))
        out.append(score)
    return out


TEXTS = ["connection refused by host", "connection reset", "user logged in", "host host host unreachable", "connection to host refused again refused"]


def test_bm25_both_ways(spark):
    terms = ("connection", "host", "refused")
    rows = bm25.with_terms(lines(spark, TEXTS))
    stats = bm25.statistics(rows, terms)
    assert stats.df == {"connection": 3, "host": 3, "refused": 2}
    want = by_hand(TEXTS, terms)
    got = [r.s for r in rows.select("line_number", bm25.score(F.col("terms"), F.col("dl"), stats).alias("s")).orderBy("line_number").collect()]
    assert got == pytest.approx(want, abs=1e-12)
    posted = {r.line_number: (r.bm25, r.coverage) for r in bm25.score_postings(bm25.postings(rows), stats).collect()}
    assert {k: v[0] for k, v in posted.items()} == pytest.approx({i + 1: s for i, s in enumerate(want) if s > 0}, abs=1e-12)
    assert posted[5][1] == 1.0 and posted[2][1] == pytest.approx(1 / 3)


def test_bm25_without_terms(spark):
    rows = bm25.with_terms(lines(spark, TEXTS))
    stats = bm25.statistics(rows, ())
    assert rows.select(bm25.score(F.col("terms"), F.col("dl"), stats).alias("s")).where("s <> 0").count() == 0
    assert bm25.score_postings(bm25.postings(rows), stats).count() == 0


def test_templates(spark):
    rows = dedup.with_template(lines(spark, ["job 1 done", "job 2 done", None, "idle", "job 3 done"]))
    got = [(r.mask_key, r.text, r.first_line_number, r.occurrences) for r in dedup.numbered(dedup.templates(rows)).orderBy("first_rank").collect()]
    assert got == [("job <*> done", "job 1 done", 1, 3), ("idle", "idle", 4, 1)]


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(3)
    rows = spark.createDataFrame([(0, i, rng.choice([rng.random(), float("nan"), 0.0, -0.0, 0.5])) for i in range(500)], "source_index long, line_number long, score double").repartition(parts)
    by = ranking.rank_before()
    got = [(r.rank, r.line_number) for r in ranking.ranked(ranking.top_k(rows, 40, by), by).collect()]
    full = sorted(rows.collect(), key=lambda r: (math.isnan(r.score), -r.score if not math.isnan(r.score) else 0, r.line_number))[:40]
    assert got == [(i + 1, r.line_number) for i, r in enumerate(full)]
    m = fusion.stable_moments(rows.where("not isnan(score)").withColumn("o", F.col("line_number")), F.col("o"), "score")
    xs = sorted((r.line_number, r.score) for r in rows.collect() if not math.isnan(r.score))
    mean = sum(x for _, x in xs) / len(xs)
    assert m.mean == pytest.approx(mean, abs=1e-12)


def test_moments_and_z(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    (m,) = fusion.moments(rows, "x")
    assert m.mean == pytest.approx(7 / 3) and m.deviation == pytest.approx(math.sqrt(14 / 9))
    (c,) = fusion.moments(spark.createDataFrame([(0.1,)] * 10, "x double"), "x")
    assert c.deviation == 0.0 and spark.range(1).select(fusion.z_score(F.lit(5.0), c)).first()[0] == 0.0


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))
    r = spark.range(1).select(V.dot(a, b), V.l2_squared(a, b), V.cosine(a, b), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert tuple(r) == pytest.approx((1.0, 13.0, 1 / math.sqrt(50), 0.0))
    with pytest.raises(Exception, match="same width"):
        spark.range(1).select(V.dot(a, F.array(F.lit(1.0)))).collect()


def test_fast_dot_agrees(spark):
    rng = random.Random(1)
    q = [rng.random() for _ in range(16)]
    rows = spark.createDataFrame([([rng.random() for _ in range(16)],) for _ in range(50)], "v array<float>")
    got = rows.select(V.fast_dot(q)("v").alias("a"), V.dot(F.col("v"), V.literal(q)).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b) for r in got)


def test_best_of_group(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 2, 0.9), (2, 0, 3, 0.1)], "distinct_id long, source_index long, line_number long, score double").withColumn("dense", F.col("score")).withColumn("lexical", F.lit(None).cast("double"))
    best = ranking.best_of_group(rows, [(F.isnan("score"), False), (F.col("score"), True), (F.col("line_number"), False)])
    assert {r.distinct_id: r.score for r in best.collect()} == {1: 0.9, 2: 0.1}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0)], "query_id int, rank int, relevant int")
    relevant = spark.createDataFrame([(1, 2), (2, 0), (3, 4)], "query_id int, n_relevant long")
    got = {r.query_id: (r.rr, r.recall, r.ndcg) for r in metrics.metrics(ranked, relevant).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1] == pytest.approx((0.5, 1.0, (1 / math.log2(3) + 0.5) / ideal))
    assert got[2] == got[3] == (0.0, 0.0, 0.0)


def test_hash_embedder_column_and_query_agree(spark):
    e = HashEmbedder(8)
    texts = ["connection refused", "", "a b c d e f g h"]
    rows = e.vectors(spark.createDataFrame(list(enumerate(texts)), "distinct_id long, text string")).orderBy("distinct_id").collect()
    for t, r in zip(texts, rows):
        assert list(r.vector) == pytest.approx(e.query(t))


def test_batch_plan():
    assert batch_plan([]) == []
    assert batch_plan([5, 3, 4]) == [[1, 2, 0]]
    assert [len(b) for b in batch_plan([1] * 70)] == [32, 32, 6]
    assert all(len(b) * max(256 for _ in b) <= 1024 for b in batch_plan([256] * 9))
    assert sorted(i for b in batch_plan([7, 1] * 600) for i in b) == list(range(1200))
    assert batch_plan([2000]) == [[0]]


def test_mean_pool():
    import numpy as np

    states, mask = np.array([[[1.0, 0.0], [3.0, 0.0], [9.0, 9.0]]], np.float32), np.array([[1, 1, 0]])
    assert mean_pool(states, mask).tolist() == [[1.0, 0.0]]
    assert mean_pool(np.zeros((1, 2, 2), np.float32), np.ones((1, 2))).tolist() == [[0.0, 0.0]]


def test_wordpiece(tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(["[PAD]", "hello", "##s", "[CLS]", "[SEP]", "[UNK]", ",", "cafe", "日", "un"]))
    w = WordPiece(str(tmp_path / "v.txt"), limit=8)
    assert w.encode("Hellos, Café") == [3, 1, 2, 6, 7, 4]
    assert w.encode("日本") == [3, 8, 5, 4]
    assert w.encode("x" * 101) == [3, 5, 4]
    assert len(w.encode("hello " * 50)) == 8 and w.encode("hello " * 50)[-1] == 4


def test_rank_of_many_rows(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).cast("float").alias("score"), F.col("id").alias("source_index"), F.lit(1).alias("line_number")).repartition(9)
    order = ranking.rank_before()
    got = {r.source_index: r["rank"] for r in ranking.ranked_all(rows, order).collect()}
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.source_index))
    assert got == {r.source_index: i for i, r in enumerate(want, 1)}


def test_moments_without_reading_all_rows(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.5, 1), (-4.0, 2)], "x double, n long")
    m = fusion.weighted_moments(rows, "x", "n")
    all_ = [1.0, 1.0, 1.0, 2.5, -4.0, -4.0]
    mean = sum(all_) / 6
    assert m.mean == pytest.approx(mean) and m.deviation == pytest.approx((sum((x - mean) ** 2 for x in all_) / 6) ** 0.5)
    z = fusion.moments_with_zeros(rows, "x", 10)
    mean = -0.05
    assert z.mean == pytest.approx(mean) and z.deviation == pytest.approx(((sum((x - mean) ** 2 for x in (1.0, 2.5, -4.0)) + 7 * mean**2) / 10) ** 0.5)
    assert fusion.moments_with_zeros(rows.limit(0), "x", 10) == fusion.weighted_moments(rows.limit(0), "x", "n") == fusion.Moments(0.0, 0.0)
