"""Aggregates over graded answers and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import f_score, gain, recall

CUTOFFS = (5, 10)


def ranking_metrics(predictions: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Macro averages of recall and gain at cutoffs over (retrieved, relevant); no rows for no queries."""
    per = predictions.select(*[f(F.slice("retrieved", 1, k), F.col("relevant")).alias(f"{n}_{k}") for k in cutoffs for n, f in (("recall", recall), ("ndcg", gain))])
    averaged = per.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in per.columns])
    return averaged.filter("n > 0")


def pass_at_k(rollouts: DataFrame) -> DataFrame:
    """sample_id, the number of its solved rollouts and of all."""
    return rollouts.groupBy("sample_id").agg(F.sum(F.coalesce(F.col("solved").cast("int"), F.lit(0))).cast("long").alias("passed"), F.count(F.lit(1)).alias("k"))


def band(passed: DataFrame, lo: int, hi: int) -> DataFrame:
    """How many items have each number of passes from lo to hi."""
    return passed.filter(F.col("passed").between(lo, hi)).groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


def index_percentile(values: Column, q: float) -> Column:
    """The sorted array's element at the whole part of q times its size, rounded to 2; 0 for none."""
    s = F.sort_array(values)
    at = F.least(F.size(s) - 1, F.floor(F.lit(q) * F.size(s))).cast("int")
    return F.coalesce(F.round(F.get(s, at), 2), F.lit(0.0))


def index_percentiles(table: DataFrame, value: str, quantiles: dict[str, float], by: str | None = None) -> DataFrame:
    """The same over rows: for each group the value at the whole part of q times their number in sorted order.

    Exact, from counts by value rounded to 2 (which keeps the order), so a group is as many rows as it has
    such values, and no list is made. Nulls count for nothing; a group of nulls only has 0.
    """
    group = [by] if by else []
    counts = table.groupBy(*group, F.round(value, 2).alias("v")).agg(F.count(value).alias("n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    summed = counts.withColumns({"upto": F.sum("n").over(whole.orderBy(F.asc_nulls_first("v"))), "all": F.sum("n").over(whole)})
    at = lambda q: F.least(F.col("all") - 1, F.floor(F.lit(q) * F.col("all")))
    found = [F.coalesce(F.min(F.when((F.col("n") > 0) & (F.col("upto") > at(q)), F.col("v"))), F.lit(0.0)).alias(name) for name, q in quantiles.items()]
    return summed.groupBy(*group).agg(*found)


def rollout_summary(rollouts: DataFrame, wall_s: float) -> DataFrame:
    """One row: items, throughput, error rate, latency percentiles and histograms of rollouts (sample_id, solved, error, latency)."""
    n = F.count(F.lit(1))
    wall = F.greatest(F.lit(float(wall_s)), F.lit(1e-9))
    totals = rollouts.agg(
        n.alias("rollouts"),
        F.count_distinct("sample_id").alias("items"),
        F.count("error").alias("errors"),
        F.round(F.count("error") / F.greatest(n, F.lit(1)), 4).alias("error_rate"),
        F.round(n / wall * 60, 1).alias("rollouts_per_min"),
        F.round(F.count_distinct("sample_id") / wall * 60, 1).alias("items_per_min"),
        F.round(F.coalesce(F.max("latency"), F.lit(0.0)), 2).alias("latency_max"),
    )
    latency = index_percentiles(rollouts, "latency", {"latency_p50": 0.5, "latency_p95": 0.95})
    listed = lambda t, c: t.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(c).cast("string"), "n")))))
    solved = listed(counts_by(pass_at_k(rollouts), "passed"), "passed").toDF("pass_histogram")
    errors = listed(counts_by(rollouts.filter("error is not null"), "error"), "error").toDF("error_histogram")
    return totals.crossJoin(latency).crossJoin(solved).crossJoin(errors)


def rollout_rows(runs: DataFrame, timeout_s: float) -> DataFrame:
    """sample_id, rollout, solved, error and latency of runs, with one schema however they ended.

    runs: sample_id, rollout, verdict, exception (the name of its type, null if none) and latency. One that
    raised is unsolved, with that name; one that took the timeout or more is unsolved, with TimeoutError.
    """
    late = F.coalesce(F.col("latency") >= timeout_s, F.lit(False))
    error = F.when(late, "TimeoutError").otherwise(F.nullif("exception", F.lit("")))
    rows = runs.select("sample_id", "rollout", "verdict", error.alias("error"), F.least(F.col("latency"), F.lit(float(timeout_s))).alias("latency"))
    return rows.select("sample_id", "rollout", (F.col("error").isNull() & F.coalesce(F.col("verdict") == "Correct", F.lit(False))).alias("solved"), "error", "latency")


def counts_by(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def label_shares(graded: DataFrame) -> DataFrame:
    """Shares of correct (A), incorrect (B) and unattempted (C) answers, and the F score."""
    n = F.count(F.lit(1))
    a, b, c = (F.count_if(F.col("grade") == g) for g in "ABC")
    share = lambda x: F.round(x / F.greatest(n, F.lit(1)), 6)
    attempted = F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    return graded.agg(n.alias("n"), share(a).alias("correct"), share(b).alias("incorrect"), share(c).alias("not_attempted"), F.round(attempted, 6).alias("correct_given_attempted"), F.round(f_score(a, b, n), 6).alias("f_score"))


def accuracy(graded: DataFrame) -> DataFrame:
    """Share judged yes, and share that has an answer at all."""
    return graded.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("judged") == "yes", F.lit(False)).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.coalesce(F.trim("answer"), F.lit("")) != "").cast("double")), 6).alias("answered"))


def rewards(rows: DataFrame) -> DataFrame:
    """One reward a row with a fixed set of columns: set answers by their score, others by the judge's verdict.

    rows: sample_id, answer_type, answer, verdict, and set_reward, recall_at_est, rank, n_pred, parse.
    """
    is_set = F.col("answer_type") == "paper_set"
    given = F.coalesce(F.col("answer") != "", F.lit(False))
    only = lambda c: F.when(is_set, F.col(c)).alias(c)
    return rows.select(
        "sample_id",
        F.when(is_set, F.coalesce("set_reward", F.lit(0.0))).when(given & (F.col("verdict") == "Correct"), 1.0).otherwise(0.0).alias("score"),
        F.when(is_set, "paper_set").when(given, "judge").otherwise("no_answer").alias("method"),
        *[only(c) for c in ("parse", "recall_at_est", "rank", "n_pred")],
    )


def reward_summary(rewarded: DataFrame) -> DataFrame:
    """Mean score, rows by method and failed parses of a batch."""
    out = rewarded.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        *[F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("judge", "paper_set", "no_answer")],
        F.count_if(F.col("parse").isin("empty", "no_answer")).alias("parse_failures"),
    )
    return out


def costs(calls: DataFrame) -> DataFrame:
    return calls.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"), F.count(F.lit(1)).alias("calls"), F.count("cost").alias("calls_with_cost"))


def solve_rates(rollouts: DataFrame, policy: str) -> DataFrame:
    return rollouts.groupBy(policy).agg(F.round(F.avg(F.coalesce(F.col("solved").cast("double"), F.lit(0.0))) * 100, 4).alias("solve_rate"))


def result_rows(metrics: DataFrame, policy: str, bench: str, **provenance: str | int | float | None) -> DataFrame:
    """One row a bench: its metrics as a map, the number of items and where they come from, null where unknown."""
    known = ("run", "checkpoint_path", "globalstep", "tool_surface", "grader_model", "model", "git_sha", "created")
    if unknown := set(provenance) - set(known):
        raise ValueError(f"unknown provenance: {', '.join(sorted(unknown))}")
    pairs = [x for c in metrics.columns if c != "n" for x in (F.lit(c), F.col(c).cast("double"))]
    given = [F.lit(provenance.get(k)).cast("string").alias(k) for k in known]
    return metrics.select(F.lit(policy).alias("policy"), F.lit(bench).alias("bench"), "n", F.create_map(*pairs).alias("metrics"), *given)


def separation_loss(tokens: DataFrame) -> DataFrame:
    """Mean over unmasked tokens of the cross-entropy between log_z and whether the advantage is negative."""
    z = F.col("log_z")
    y = F.when(F.col("advantage") < 0, 0.0).otherwise(1.0)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return tokens.filter("mask").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))
