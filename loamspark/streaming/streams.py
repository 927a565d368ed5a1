"""Streams of work: resume, micro-batches to two sinks, rolling statistics, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evaluation import reward_summary, rewards


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """The files of a folder (or one file) as a stream, with `ts` as a time that can carry a watermark."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream's source is a folder
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent())).withColumn("ts", F.col("ts").cast("timestamp"))
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, as far back as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def window_stats(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Count, errors and mean value of each tumbling window and kind of event; for streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    by = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 0).alias("n_negative"), F.round(F.avg("value"), 6).alias("mean_value"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "n_negative", "mean_value")


def latency_stats(events: DataFrame, length: str, late: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Median and 95th percentile of each window's values: of a rank at most their number over `accuracy` off, so exact below that."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    by = marked.groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [0.5, 0.95], accuracy).alias("p"))
    return by.select(F.col("w.start").alias("window_start"), "n", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"))


def to_files(stream: DataFrame, folder: str, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there into a folder, and return its table.

    Each micro-batch is written under its number, so one that is run again takes its own place. What counts
    is all batches (append), the last one (complete), or each key's row of the last batch that has it (update).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in key]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
        return last.select(*[F.col(c) if c in key else F.col("last")[c].alias(c) for c in stream.columns])
    return rows.drop("batch")


def two_sinks(stream: DataFrame, details: str, summary: str, checkpoint: str, key: str) -> StreamingQuery:
    """Each micro-batch's rows first, then its summary by key, both under the batch's number.

    A batch that is run again overwrites its own folders, so neither sink has it twice, and no item is
    in the summary that isn't in the details.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{details}/batch={number}")
        batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{summary}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reward_steps(stream: DataFrame, folder: str) -> StreamingQuery:
    """Rewards of a stream of graded rows, a micro-batch being a step: all its rows as JSON lines in step=N, and a summary of one row.

    A step that is run again overwrites its own folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        rewarded = rewards(batch).persist()
        rewarded.write.mode("overwrite").json(f"{folder}/rows/step={number}")
        reward_summary(rewarded).write.mode("overwrite").json(f"{folder}/summary/step={number}")
        rewarded.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def resume(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append what hasn't been processed yet; the checkpoint remembers what has.

    Once over what is there, or on and on with a micro-batch each interval ("10 seconds").
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()


SESSION = "user_id long, n_turns long, last_type string, reason string"


def session_states(stream: DataFrame, terminal: str, most: int) -> DataFrame:
    """A running row for each user_id: turns, last event and how it ended (terminal event or max_turns), else 'open'."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, reason = state.get if state.exists else (0, None, "open")
        parts = list(batches)  # a trigger's rows of one user can come in several parts: they are sorted together
        for kind in pd.concat(parts).sort_values("event_id").event_type if parts else ():
            if reason == "open":
                n, last = n + 1, kind
                reason = "terminal" if kind == terminal else "max_turns" if n >= most else "open"
        state.update((n, last, reason))
        yield pd.DataFrame({"user_id": [key[0]], "n_turns": [n], "last_type": [last], "reason": [reason]})

    return stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(step, SESSION, "n long, last string, reason string", "update", GroupStateTimeout.NoTimeout)


def session_table(events: DataFrame, terminal: str, most: int) -> DataFrame:
    """What session_states comes to once all events are in, by built-in functions."""
    turns = events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("t"))
    at = F.array_position("t", terminal)
    n = F.least(F.when(at > 0, at).otherwise(F.size("t")), F.lit(most), F.size("t")).cast("long")
    last = F.get("t", (n - 1).cast("int"))
    return turns.select("user_id", n.alias("n_turns"), last.alias("last_type"), F.when(last == terminal, "terminal").when(n >= most, "max_turns").otherwise("open").alias("reason"))
