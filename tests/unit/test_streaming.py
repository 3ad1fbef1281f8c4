from siltstone.streaming import journal as J
from siltstone.streaming import state as K

SCHEMA = "session string, commit long, regressed long, exempt boolean"


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def feed(spark, path):
    for part in ([("a", 1, 2, False), ("a", 2, 5, True), ("b", 1, 0, False)], [("a", 3, 1, False), ("b", 7, None, None)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_drift_monitor_keeps_totals(spark, tmp_path):
    path = str(tmp_path / "in")
    feed(spark, path)
    seen = []
    q = J.drift_monitor(stream(spark, path)).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend((i, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {s: (n, bad, c) for _, s, n, bad, c in sorted(seen, key=lambda r: r[2])}
    assert last == {"a": (3, 3, 3), "b": (2, 0, 7)}


def test_append_is_idempotent(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, path)
    for cp in ("one", "two"):  # a second query hands the same rows over again
        J.on_batches(stream(spark, path), lambda df, i: J.append_unseen(df, out, "commit"), str(tmp_path / cp)).awaitTermination()
    assert sorted(r.commit for r in spark.read.parquet(out).collect()) == [1, 2, 3, 7]


def test_windows_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "e")
    events.selectExpr("cast(ts as timestamp) ts", "event_type", "value").repartition(3).write.parquet(path)
    live = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(path)
    J.windowed(live, "ts", "1 day", None, ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("live_windows").trigger(availableNow=True).start().awaitTermination()
    batch = J.windowed(spark.read.parquet(path), "ts", "1 day", None, ["event_type"], "value")
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("live_windows").collect())) == sorted(map(key, batch.collect()))


def test_counts_are_carried_over_restarts(spark, tmp_path):
    """Three passes, each a stream of its own from the same checkpoint; nulls have no state; the session's store setting is put back."""
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    before = spark.conf.get(K.PROVIDER)
    for part in ([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], [("a", "x"), (None, "x"), ("b", None)], [("b", "x"), ("a", "z")]):
        spark.createDataFrame(part, "s string, i string").write.mode("append").parquet(source)
        K.pass_over(spark, K.carried(spark.readStream.schema("s string, i string").parquet(source), "s", "i"), sink, checkpoint)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == [("a", "x", 2, 1), ("a", "x", 3, 2), ("a", "y", 1, 1), ("a", "z", 1, 3), ("b", "x", 1, 1), ("b", "x", 2, 2)]
    assert spark.conf.get(K.PROVIDER) == before
