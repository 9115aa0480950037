"""Streams give the windows that a batch gives, and a restarted intake resumes."""

from pyspark.sql import functions as F

from quarrymill.sources.tables import table
from quarrymill.streaming import events as S

SF = "/root/testdata/sf0.001"


def test_stream_windows_equal_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    raw.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.windowed_counts(S.read_events(spark, str(tmp_path / "in"), raw.schema), "ts", "event_type", "value", "1 day", late="1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = S.windowed_counts(table(spark, SF, "events"), "ts", "event_type", "value", "1 day")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_intake_resumes_and_drops_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    for k in range(2):
        rows.withColumn("id", F.col("id") + 10 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.once(S.read_events(spark, str(tmp_path / "in"), rows.schema), "id", "ts")
        S.intake(stream, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 11, 12]
