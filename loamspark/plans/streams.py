"""Queries over streams: what a stream comes to once all of its files are in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traces import fold
from ..sources import shared
from ..streaming import streams
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.event_stream(spark, f"{sf}/events.parquet")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value < 0) AS n_negative, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.to_files(streams.window_stats(_events(spark, sf), "6 hours"), shared.folder(spark, "windows"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, sum(event_id)::BIGINT AS total FROM events")
def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    twice = events.union(events)
    out = streams.to_files(streams.once(twice.select("event_id", "ts"), "event_id", "60 days"), shared.folder(spark, "once"), "append")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"), F.sum("event_id").alias("total"))


_TURNS = "t AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY 1), n AS (SELECT user_id, t, least(coalesce(list_position(t, 'purchase'), len(t)), 12, len(t)) AS n FROM t)"


@query(f"WITH {_TURNS} SELECT user_id, n::BIGINT AS n_turns, t[n] AS last_type, CASE WHEN t[n] = 'purchase' THEN 'terminal' WHEN n >= 12 THEN 'max_turns' ELSE 'open' END AS reason FROM n")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The stateful stream itself, run to its end."""
    return streams.to_files(streams.session_states(_events(spark, sf), "purchase", 12), shared.folder(spark, "sessions"), "update", ["user_id"])


@query(f"WITH {_TURNS} SELECT user_id, n::BIGINT AS n_turns, t[n] AS last_type, CASE WHEN t[n] = 'purchase' THEN 'terminal' WHEN n >= 12 THEN 'max_turns' ELSE 'open' END AS reason FROM n")
def session_table(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream comes to, by built-in functions over the table."""
    return streams.session_table(_events_table(spark, sf), "purchase", 12)


def _events_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_two_sinks(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared.folder(spark, "two-sinks")
    details, summary = f"{folder}/details", f"{folder}/summary"
    streams.two_sinks(_events(spark, sf), details, summary, f"{folder}/checkpoint", "event_type").awaitTermination()
    return spark.read.parquet(summary).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT user_id, count(*)::INT AS n_turns, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def event_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fold(_events_table(spark, sf), "user_id", "event_id", "event_type").select("user_id", "n_turns", F.element_at("turns", -1)["event_type"].alias("last_type"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.latency_stats(_events_table(spark, sf), "1 day", accuracy=1_000_000)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "p50", "p95")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_users, sum(event_id)::BIGINT AS total FROM events")
def stream_resume(spark: SparkSession, sf: str) -> DataFrame:
    """A stream that is stopped after its first files and started again: the checkpoint remembers what is done."""
    folder = shared.folder(spark, "resume")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        for _ in range(2):  # the second run finds nothing new
            streams.resume(streams.event_stream(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.sum("event_id").alias("total"))


_GRADED = (
    "event_id AS sample_id",
    "CASE event_id % 3 WHEN 0 THEN 'paper_set' ELSE 'value' END AS answer_type",
    "CASE event_id % 5 WHEN 0 THEN '' ELSE 'a' END AS answer",
    "CASE event_type WHEN 'purchase' THEN 'Correct' ELSE 'Incorrect' END AS verdict",
    "value AS set_reward",
    "0.5D AS recall_at_est",
    "0.5D AS rank",
    "3 AS n_pred",
    "CASE event_id % 7 WHEN 0 THEN 'empty' ELSE 'json' END AS parse",
)


@query("""WITH g AS (SELECT CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 5 <> 0 AND event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS score, CASE WHEN event_id % 3 = 0 THEN 'paper_set' WHEN event_id % 5 <> 0 THEN 'judge' ELSE 'no_answer' END AS method, event_id FROM events)
SELECT method, count(*) AS n, round(sum(score), 4) AS total, count(*) FILTER (event_id % 21 = 0) AS failures, (SELECT count(*) FROM events) AS n_summed FROM g GROUP BY 1""")
def stream_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps of rewards; the summaries' rows add up to all."""
    folder = shared.folder(spark, "rewards")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3, "event_id").write.parquet(f"{folder}/in")
    graded = streams.event_stream(spark, f"{folder}/in", 1).selectExpr(*_GRADED)
    streams.reward_steps(graded, folder).awaitTermination()
    rows = spark.read.schema("sample_id long, score double, method string, parse string").json(f"{folder}/rows")
    n = spark.read.schema("n long").json(f"{folder}/summary").agg(F.sum("n").alias("n_summed"))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.count_if(F.col("parse") == "empty").alias("failures")).crossJoin(n)
