from pyspark.sql import functions as F

from siftlog.operators import bm25
from siftlog.streaming.lines import scored, templates_by_window, top_k_of_batches


def stream(spark, tmp_path, rows):
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, "source_index long, line_number long, ts timestamp, text string").write.parquet(d)
    return spark.readStream.schema("source_index long, line_number long, ts timestamp, text string").parquet(d)


def test_templates_and_scores_on_a_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(0, i, t + dt.timedelta(minutes=i), f"job {i} done" if i % 3 else "idle host") for i in range(1, 31)]
    s = stream(spark, tmp_path, rows)
    q = templates_by_window(s, "ts").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 30
    frozen = bm25.with_terms(spark.createDataFrame(rows, "source_index long, line_number long, ts timestamp, text string"))
    stats = bm25.statistics(frozen, ("idle",))
    got = []
    q = top_k_of_batches(scored(s, stats), 2, "bm25", lambda b, n: got.extend(r.line_number for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got == [3, 6]
