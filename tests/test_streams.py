from pyspark.sql import functions as F

from loamspark.streaming import streams


def events(spark, tmp_path, files=3, n=90):
    for k in range(files):
        rows = spark.range(k * n // files, (k + 1) * n // files).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "id % 4 AS user_id", "CASE WHEN id % 13 = 0 THEN 'purchase' ELSE 'view' END AS event_type", "CAST(id % 7 AS DOUBLE) AS value")
        rows.coalesce(1).write.parquet(str(tmp_path / "events" / f"part={k}"))
    return str(tmp_path / "events")


def test_windows_in_complete_mode_are_those_of_the_table(spark, tmp_path):
    path = events(spark, tmp_path)
    got = streams.to_files(streams.window_stats(streams.event_stream(spark, path, 1), "30 minutes"), str(tmp_path / "w"), "complete")
    want = streams.window_stats(spark.read.parquet(path), "30 minutes")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_each_id_once(spark, tmp_path):
    path = events(spark, tmp_path)
    stream = streams.event_stream(spark, path, 1).select("event_id", "ts")
    got = streams.to_files(streams.once(stream.union(stream), "event_id", "10 days"), str(tmp_path / "o"), "append")
    assert sorted(r.event_id for r in got.collect()) == list(range(90))


def test_sessions_are_those_of_the_table(spark, tmp_path):
    path = events(spark, tmp_path)
    last = streams.to_files(streams.session_states(streams.event_stream(spark, path, 1), "purchase", 9), str(tmp_path / "s"), "update", ["user_id"])
    want = streams.session_table(spark.read.parquet(path), "purchase", 9)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_sort_what_comes_in_many_parts(spark, tmp_path):
    # far more rows of one user in a trigger than an Arrow batch holds, the last first
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("99 - id AS event_id", "timestamp_seconds(1700000000) AS ts", "1L AS user_id", "concat('e', 99 - id) AS event_type", "1.0D AS value")
        rows.coalesce(1).write.parquet(str(tmp_path / "e"))
        got = streams.to_files(streams.session_states(streams.event_stream(spark, str(tmp_path / "e")), "purchase", 40), str(tmp_path / "s"), "update", ["user_id"])
        assert [tuple(r) for r in got.collect()] == [(1, 40, "e39", "max_turns")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_two_sinks_and_resume(spark, tmp_path):
    path = events(spark, tmp_path, 2)
    run = lambda: streams.two_sinks(streams.event_stream(spark, path, 1), str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "c"), "event_type").awaitTermination()
    run()
    run()  # nothing is done twice
    assert spark.read.parquet(str(tmp_path / "d")).count() == 90
    assert spark.read.parquet(str(tmp_path / "s")).agg(F.sum("n")).first()[0] == 90
    for _ in range(2):
        streams.resume(streams.event_stream(spark, path, 1), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 90


def test_latency(spark, tmp_path):
    got = streams.latency_stats(spark.read.parquet(events(spark, tmp_path)), "30 minutes").collect()
    assert sum(r.n for r in got) == 90 and all(r.p50 <= r.p95 for r in got)
