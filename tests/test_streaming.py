from larkspur.streaming import events_stream, windowed_activity


def test_stream_equals_table(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(3):
        source.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windowed_activity(events_stream(spark, str(tmp_path / "in"), files="*.parquet"), late="60 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT window_start, event_type, max(n) AS n FROM activity GROUP BY 1, 2")
    want = windowed_activity(source).select("window_start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
