"""The streaming forms give what the same functions give on a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from weftline.streaming import flows


def test_windows_on_a_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a" if i % 2 else "b", t + timedelta(minutes=37 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    df.write.parquet(str(tmp_path / "in"))
    agg = lambda d: flows.windowed(flows.event_time(d, "ts", "1 hour"), ["k"], "6 hours", None, F.count(F.lit(1)).alias("n"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = agg(stream).writeStream.format("memory").queryName("flow").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("flow").collect())) == sorted(map(str, agg(df).collect()))


def test_state_and_log(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1.0, 2020), ("a", t + timedelta(hours=1), 2.0, 2021), ("b", t, 4.0, 2020)], "k string, ts timestamp, v double, event_year int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.event_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
    seen = []
    state = flows.smoothed_state(stream, "k", "v", 0.5)
    q = state.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: r["state"] for r in seen} == {"a": 2.5, "b": 4.0}
    log = flows.append_by_year(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c3"))
    log.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).filter("event_year = 2020").count() == 2
