from __future__ import annotations

from chronomesh.operators import sequences
from chronomesh.streaming import sequences as streams


def test_refractory_stream_equals_batch(spark, tmp_path):
    schema = "channel long, t long"
    rows = [(c, t) for c in (1, 2) for t in (0, 150, 210, 400, 410, 700, 880)]
    for n, part in enumerate((rows[:3] + rows[7:9], rows[3:7] + rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if n == 0:
            stream = streams.refractory(spark.readStream.schema(schema).json(str(tmp_path / "in")), "channel", "t", 200)
            query = stream.writeStream.format("memory").queryName("kept").outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    want = sequences.refractory(spark.createDataFrame(rows, schema), "channel", "t", 200)
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, want.collect()))


def test_state_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:59", "a"), ("2024-01-01 00:01:30", "b"), ("2024-01-01 01:00:00", "a")]
    spark.createDataFrame(rows, "ts string, s string").write.json(str(tmp_path / "in"))
    stream = streams.state_counts(spark.readStream.schema("ts timestamp, s string").json(str(tmp_path / "in")), "ts", "s", "1 minute", "10 seconds")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.s, r.n) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]
