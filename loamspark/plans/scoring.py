"""Queries that score answers, rankings and rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import evaluation, synthesis
from .fixtures import table
from .registry import query

_PRED = """pred AS (SELECT conv_id, [(conv_id * 3 + k * 7) % 11 FOR k IN range(0, conv_id % 8)] AS retrieved, [(conv_id * 5 + k * 3) % 11 FOR k IN range(0, conv_id % 4)] AS relevant FROM (SELECT DISTINCT conv_id FROM conversations))"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id").distinct().selectExpr(
        "conv_id",
        "CASE WHEN conv_id % 8 = 0 THEN array() ELSE transform(sequence(0L, conv_id % 8 - 1), k -> (conv_id * 3 + k * 7) % 11) END AS retrieved",
        "CASE WHEN conv_id % 4 = 0 THEN array() ELSE transform(sequence(0L, conv_id % 4 - 1), k -> (conv_id * 5 + k * 3) % 11) END AS relevant",
    )


def _ranking(k: int) -> str:
    hits = f"list_filter(range(1, least({k}, len(retrieved)) + 1), lambda i: list_contains(relevant, retrieved[i]))"
    return f"""CASE WHEN len(relevant) = 0 THEN 0.0 ELSE len(list_intersect(retrieved[1:{k}], relevant)) / len(relevant) END AS recall_{k},
CASE WHEN len(relevant) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform({hits}, lambda i: 1.0::DOUBLE / i)), 0) / list_sum(list_transform(range(1, len(relevant) + 1), lambda i: 1.0::DOUBLE / i)) END AS ndcg_{k}"""


@query(f"WITH {_PRED}, m AS (SELECT {_ranking(5)}, {_ranking(10)} FROM pred) SELECT count(*) AS n, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10) for m in ("recall", "ndcg")) + " FROM m")
def metric_recall_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ranking_metrics(_predictions(spark, sf))


@query(f"WITH {_PRED}, m AS (SELECT conv_id, {_ranking(5)} FROM pred) SELECT conv_id, round(recall_5, 6) AS recall_5, round(ndcg_5, 6) AS ndcg_5 FROM m")
def metric_per_query(spark: SparkSession, sf: str) -> DataFrame:
    p = _predictions(spark, sf)
    first = F.slice("retrieved", 1, 5)
    return p.select("conv_id", F.round(scores.recall(first, F.col("relevant")), 6).alias("recall_5"), F.round(scores.gain(first, F.col("relevant")), 6).alias("ndcg_5"))


_SETS = f"""{_PRED}, gold AS (SELECT conv_id AS sample_id, (conv_id + g * 2) % 11 AS corpus_id, CASE WHEN g = 0 THEN 3 ELSE (conv_id + g) % 4 END AS grade FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 5) t(g))"""


@query(f"""WITH {_SETS}, est AS (SELECT sample_id, count(*) FILTER (grade >= 3) AS total FROM gold GROUP BY 1),
p AS (SELECT conv_id AS sample_id, list_transform(list_filter(range(1, len(retrieved) + 1), lambda i: NOT list_contains(retrieved[1:i - 1], retrieved[i])), lambda i: retrieved[i]) AS ids FROM pred),
u AS (SELECT sample_id, unnest(ids) AS corpus_id, generate_subscripts(ids, 1) AS pos FROM p), g AS (SELECT u.sample_id, u.pos, coalesce(grade, 0) AS grade FROM u LEFT JOIN gold USING (sample_id, corpus_id)),
l AS (SELECT p.sample_id, coalesce((SELECT list(grade ORDER BY pos) FROM g WHERE g.sample_id = p.sample_id), []) AS s FROM p),
d AS (SELECT sample_id, s, coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i] / ln(i + 1))), 0) AS dcg, coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: list_reverse_sort(s)[i] / ln(i + 1))), 0) AS hi, coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: list_sort(s)[i] / ln(i + 1))), 0) AS lo FROM l),
m AS (SELECT sample_id, len(s)::INT AS n_pred, total, CASE WHEN total > 0 THEN len(list_filter(s[1:total], lambda x: x >= 3)) / total ELSE 0 END AS rc, CASE WHEN len(s) = 0 THEN 0 WHEN list_max(s) = list_min(s) THEN (hi > 0)::INT ELSE (dcg - lo) / (hi - lo) END AS rk FROM d JOIN est USING (sample_id))
SELECT sample_id, n_pred, total, round(rc, 6) AS recall_at_est, round(rk, 6) AS rank, round(CASE WHEN rc > 0 AND rk > 0 THEN 2 * rc * rk / (rc + rk) ELSE 0 END, 6) AS reward FROM m""")
def metric_adjusted_f1(spark: SparkSession, sf: str) -> DataFrame:
    predicted = _predictions(spark, sf).select(F.col("conv_id").alias("sample_id"), F.col("retrieved").cast("array<bigint>").alias("ids"))
    g = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("g")
    gold = predicted.select("sample_id", g).selectExpr("sample_id", "(sample_id + g * 2) % 11 AS corpus_id", "CAST(CASE WHEN g = 0 THEN 3 ELSE (sample_id + g) % 4 END AS INT) AS grade", "CAST(NULL AS BIGINT) AS est")
    return synthesis.paper_set_scores(predicted, gold)


_PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
_SAY = "CASE doc_id % 6 WHEN 0 THEN concat('The ', w, '!') WHEN 1 THEN concat(upper(w), '  a') WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat(w, 's') END"
_QA = f"qa AS (SELECT doc_id, w, {_SAY} AS answer, [w, concat('x', w)] AS golds FROM (SELECT doc_id, split_part(text, ' ', 2) AS w FROM documents))"


def _norm_sql(x: str) -> str:
    bare = f"translate(lower({x}), {_PUNCT}, '')"
    return rf"CASE WHEN {x} IS NOT NULL THEN array_to_string(list_filter(regexp_split_to_array({bare}, '\s+'), lambda v: v NOT IN ('', 'a', 'an', 'the')), ' ') END"


@query(f"WITH {_QA} SELECT doc_id, {_norm_sql('answer')} AS normalised, coalesce({_norm_sql('answer')} IN ({_norm_sql('golds[1]')}, {_norm_sql('golds[2]')}), false) AS em FROM qa")
def metric_em(spark: SparkSession, sf: str) -> DataFrame:
    # SQL's concat passes over nulls, and its upper case is one character for each
    docs = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("gold"))
    docs = docs.withColumn("w", F.coalesce("gold", F.lit(""))).withColumn("up", text.upper_by_character("w"))
    docs = docs.selectExpr("doc_id", f"{_SAY.replace('upper(w)', 'up')} AS answer", "array(gold, concat('x', w)) AS golds")
    n = text.answer_form("answer")
    return docs.select("doc_id", n.alias("normalised"), F.coalesce(F.exists("golds", lambda g: text.answer_form(g) == n), F.lit(False)).alias("em"))


_GAIA_GOLD = "CASE doc_id % 5 WHEN 0 THEN concat(doc_id, '') WHEN 1 THEN concat(doc_id, ', ', w) WHEN 2 THEN w WHEN 3 THEN concat(w, '; b c; 1.50') ELSE concat('1e', doc_id % 4) END"
_GAIA_SAID = "CASE doc_id % 5 WHEN 0 THEN concat('$', doc_id + (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END)) WHEN 1 THEN concat(doc_id, ',   ', w) WHEN 2 THEN concat(' ', w, '. ') WHEN 3 THEN concat(w, ';bc;1.5', CASE WHEN doc_id % 2 = 0 THEN '' ELSE ';x' END) ELSE concat('1', repeat('0', CAST(doc_id % 4 AS INT))) END"
_IS_NUM = r"regexp_full_match(trim({0}), '(?i)[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?')"


@query(f"""WITH g AS (SELECT doc_id, {_GAIA_GOLD} AS gold, {_GAIA_SAID} AS said FROM (SELECT doc_id, split_part(text, ' ', 2) AS w FROM documents)),
l AS (SELECT *, regexp_split_to_array(gold, '[,;]') AS gs, regexp_split_to_array(said, '[,;]') AS ss FROM g)
SELECT doc_id, CASE WHEN {_IS_NUM.format('gold')} THEN coalesce(try_cast(translate(said, '$%,', '') AS DOUBLE), 'inf'::DOUBLE) = try_cast(gold AS DOUBLE)
WHEN regexp_matches(gold, '[,;]') THEN len(gs) = len(ss) AND len(list_filter(range(1, len(gs) + 1), lambda i: NOT CASE WHEN {_IS_NUM.format('gs[i]')} THEN coalesce(try_cast(translate(ss[i], '$%,', '') AS DOUBLE), 'inf'::DOUBLE) = try_cast(gs[i] AS DOUBLE) ELSE lower(regexp_replace(ss[i], '\\s+', '', 'g')) = lower(regexp_replace(gs[i], '\\s+', '', 'g')) END)) = 0
ELSE translate(lower(regexp_replace(said, '\\s+', '', 'g')), {_PUNCT}, '') = translate(lower(regexp_replace(gold, '\\s+', '', 'g')), {_PUNCT}, '') END AS correct FROM l""")
def metric_gaia(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(2)).alias("w")).selectExpr("doc_id", f"{_GAIA_GOLD} AS gold", f"{_GAIA_SAID} AS said")
    return rows.select("doc_id", scores.gaia_correct(F.col("said"), F.col("gold")).alias("correct"))


_GRADES = "g AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'none' WHEN quality = 1 THEN 'A: right' ELSE 'B' END AS said FROM labels), h AS (SELECT coalesce(nullif(regexp_extract(said, '(A|B|C)', 1), ''), 'C') AS grade FROM g)"


@query(f"""WITH {_GRADES}, c AS (SELECT count(*) AS n, count(*) FILTER (grade = 'A') AS a, count(*) FILTER (grade = 'B') AS b, count(*) FILTER (grade = 'C') AS c FROM h)
SELECT n, round(a / n, 6) AS correct, round(b / n, 6) AS incorrect, round(c / n, 6) AS not_attempted, round(a / greatest(a + b, 1), 6) AS correct_given_attempted, round(CASE WHEN a > 0 THEN 2 * (a / n) * (a / (a + b)) / (a / n + a / (a + b)) ELSE 0 END, 6) AS f_score FROM c""")
def metric_simpleqa(spark: SparkSession, sf: str) -> DataFrame:
    said = table(spark, sf, "labels").selectExpr("CASE WHEN doc_id % 9 = 0 THEN 'none' WHEN quality = 1 THEN 'A: right' ELSE 'B' END AS said")
    return evaluation.label_shares(said.select(text.grade_letter("said").alias("grade")))


@query("WITH g AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN quality = 1 THEN 'Correct : YES' ELSE 'correct: no' END AS said, CASE WHEN toxic = 1 THEN ' ' ELSE 'x' END AS answer FROM labels) SELECT count(*) AS n, round(avg(coalesce(lower(regexp_extract(said, '(?i)correct\\s*:\\s*(yes|no)', 1)) = 'yes', false)::INT), 6) AS accuracy, round(avg((trim(answer) <> '')::INT), 6) AS answered FROM g")
def metric_browsecomp(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("CASE WHEN doc_id % 7 = 0 THEN NULL WHEN quality = 1 THEN 'Correct : YES' ELSE 'correct: no' END AS said", "CASE WHEN toxic = 1 THEN ' ' ELSE 'x' END AS answer")
    return evaluation.accuracy(rows.withColumn("judged", text.says_correct("said")))


_ROLL = "roll AS (SELECT doc_id // 4 AS sample_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE quality = 1 END AS solved, CASE WHEN toxic = 1 THEN 'Timeout' END AS error, (doc_id % 97) / 7.0::DOUBLE AS latency, concat('p', doc_id % 3) AS policy FROM labels)"


def _rollouts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id div 4 AS sample_id", "CASE WHEN doc_id % 10 = 3 THEN NULL ELSE quality = 1 END AS solved", "CASE WHEN toxic = 1 THEN 'Timeout' END AS error", "(doc_id % 97) / CAST(7.0 AS DOUBLE) AS latency", "concat('p', doc_id % 3) AS policy")


_PASS = f"WITH {_ROLL}, p AS (SELECT sample_id, sum(coalesce(solved::INT, 0))::BIGINT AS passed, count(*) AS k FROM roll GROUP BY 1)"


@query(f"{_PASS} SELECT * FROM p")
def pass_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pass_at_k(_rollouts(spark, sf))


@query(f"{_PASS} SELECT passed, count(*) AS n FROM p WHERE passed BETWEEN 1 AND 3 GROUP BY 1")
def difficulty_band(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.band(evaluation.pass_at_k(_rollouts(spark, sf)), 1, 3)


@query(f"{_PASS} SELECT passed, count(*) AS n FROM p GROUP BY 1")
def pass_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.counts_by(evaluation.pass_at_k(_rollouts(spark, sf)), "passed")


@query(f"WITH {_ROLL} SELECT error, count(*) AS n FROM roll GROUP BY 1")
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.counts_by(_rollouts(spark, sf), "error")


@query(f"WITH {_ROLL}, l AS (SELECT policy, list_sort(list(latency)) AS s FROM roll GROUP BY 1) SELECT policy, round(s[least(len(s) - 1, floor(0.5 * len(s))::BIGINT) + 1], 2) AS p50, round(s[least(len(s) - 1, floor(0.95::DOUBLE * len(s))::BIGINT) + 1], 2) AS p95 FROM l")
def pct_rank_index(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.index_percentiles(_rollouts(spark, sf), "latency", {"p50": 0.5, "p95": 0.95}, "policy")


@query(f"WITH {_ROLL} SELECT count(*) AS rollouts, count(error) AS errors, round(count(error) / count(*), 4) AS error_rate, round(count(*) / 120.0::DOUBLE * 60, 1) AS rollouts_per_min, round(max(latency), 2) AS latency_max FROM roll")
def rollout_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.rollout_summary(_rollouts(spark, sf), 120.0).select("rollouts", "errors", "error_rate", "rollouts_per_min", "latency_max")


_PERCENTILE = "round((list_sort(list(latency)))[least(count(*) - 1, floor({0}::DOUBLE * count(*))::BIGINT) + 1], 2)"


@query(f"""WITH {_ROLL}, p AS (SELECT sample_id, sum(coalesce(solved::INT, 0))::BIGINT AS passed FROM roll GROUP BY 1), h AS (SELECT passed, count(*) AS n FROM p GROUP BY 1), e AS (SELECT error, count(*) AS n FROM roll WHERE error IS NOT NULL GROUP BY 1)
SELECT count(DISTINCT sample_id) AS items, round(count(DISTINCT sample_id) / 120.0::DOUBLE * 60, 1) AS items_per_min, {_PERCENTILE.format(0.5)} AS latency_p50, {_PERCENTILE.format(0.95)} AS latency_p95,
(SELECT string_agg(concat(passed, ':', n), ',' ORDER BY passed) FROM h) AS passes, (SELECT string_agg(concat(error, ':', n), ',' ORDER BY error) FROM e) AS errors_by_type FROM roll""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.rollout_summary(_rollouts(spark, sf), 120.0)
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.select("items", "items_per_min", "latency_p50", "latency_p95", shown("pass_histogram").alias("passes"), shown("error_histogram").alias("errors_by_type"))


@query("""SELECT event_id // 4 AS sample_id, event_id % 4 AS rollout, event_type = 'purchase' AND value < 50 AND event_id % 6 <> 0 AS solved,
CASE WHEN value >= 50 THEN 'TimeoutError' WHEN event_id % 6 = 0 THEN 'ValueError' END AS error, least(value, 50.0::DOUBLE) AS latency FROM events""")
def rollout_rows(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").selectExpr("event_id div 4 AS sample_id", "event_id % 4 AS rollout", "CASE WHEN event_type = 'purchase' THEN 'Correct' WHEN event_id % 5 <> 0 THEN 'Incorrect' END AS verdict", "CASE WHEN event_id % 6 = 0 THEN 'ValueError' WHEN event_id % 7 = 0 THEN '' END AS exception", "value AS latency")
    return evaluation.rollout_rows(runs, 50.0)


@query(f"WITH {_ROLL} SELECT policy, round(avg(coalesce(solved::INT, 0)) * 100, 4) AS solve_rate FROM roll GROUP BY 1")
def solve_rate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.solve_rates(_rollouts(spark, sf), "policy")


@query("SELECT round(sum(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS total_cost, count(*) AS calls, count(CASE WHEN event_id % 3 = 0 THEN value END) AS calls_with_cost FROM events")
def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.costs(table(spark, sf, "events").selectExpr("CASE WHEN event_id % 3 = 0 THEN value END AS cost"))


_CAND = "c AS (SELECT doc_id // 6 AS qa_id, doc_id AS corpus_id, least(3, quality + toxic * 2 + (doc_id % 2))::INT AS grade, doc_id % 6 = 0 AS is_seed FROM labels)"


@query(f"""WITH {_CAND}, g AS (SELECT qa_id, corpus_id, CASE WHEN is_seed THEN 3 ELSE grade END AS grade FROM c), k AS (SELECT * FROM g WHERE grade >= 1),
s AS (SELECT qa_id, count(*) FILTER (grade = 3) AS est_total_relevant, string_agg(concat(corpus_id, ':', grade), ',' ORDER BY grade DESC, corpus_id) AS relevance FROM k GROUP BY 1) SELECT * FROM s WHERE est_total_relevant BETWEEN 1 AND 2""")
def gold_set_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id div 6 AS qa_id", "doc_id AS corpus_id", "least(3, quality + toxic * 2 + CAST(doc_id % 2 AS INT)) AS grade", "doc_id % 6 = 0 AS is_seed")
    sets = synthesis.gold_sets(rows, 1, 2)
    return sets.select("qa_id", "est_total_relevant", F.array_join(F.transform("relevance", lambda x: F.concat(x["corpus_id"].cast("string"), F.lit(":"), x["grade"].cast("string"))), ",").alias("relevance"))


@query("SELECT doc_id, least(3, (coalesce(quality = 1, false))::INT + (toxic = 0)::INT + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT) AS grade, quality = 1 AND toxic = 0 AND doc_id % 2 = 0 AS all_true FROM labels")
def criteria_grade(spark: SparkSession, sf: str) -> DataFrame:
    checks = [F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0]
    return table(spark, sf, "labels").select("doc_id", synthesis.grade(F.array(*checks)).alias("grade"), synthesis.rubric(*checks[:3]).alias("all_true"))


_REWARD = "CASE WHEN doc_id % 4 = 0 THEN 'paper_set' ELSE 'value' END AS answer_type, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'a' END AS answer, CASE WHEN quality = 1 THEN 'Correct' ELSE 'Incorrect' END AS verdict, CAST(doc_id % 10 AS DOUBLE) / 10 AS set_reward, CAST(0.5 AS DOUBLE) AS recall_at_est, CAST(0.25 AS DOUBLE) AS rank, CAST(doc_id % 7 AS INT) AS n_pred, CASE WHEN doc_id % 8 = 0 THEN 'empty' ELSE 'json' END AS parse"
_REWARDS = f"""WITH r AS (SELECT doc_id AS sample_id, {_REWARD} FROM labels), s AS (SELECT sample_id, CASE WHEN answer_type = 'paper_set' THEN set_reward WHEN answer <> '' AND verdict = 'Correct' THEN 1.0 ELSE 0.0 END::DOUBLE AS score,
CASE WHEN answer_type = 'paper_set' THEN 'paper_set' WHEN answer <> '' THEN 'judge' ELSE 'no_answer' END AS method, CASE WHEN answer_type = 'paper_set' THEN parse END AS parse, CASE WHEN answer_type = 'paper_set' THEN recall_at_est END AS recall_at_est, CASE WHEN answer_type = 'paper_set' THEN rank END AS rank, CASE WHEN answer_type = 'paper_set' THEN n_pred END AS n_pred FROM r)"""


def _rewarded(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id AS sample_id", *[c.strip() for c in _REWARD.replace(", CASE", "\nCASE").replace(", CAST", "\nCAST").split("\n")])
    return evaluation.rewards(rows)


@query(f"{_REWARDS} SELECT * FROM s")
def reward_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _rewarded(spark, sf)


@query(f"{_REWARDS} SELECT count(*) AS n, round(avg(score), 6) AS mean_score, " + ", ".join(f"count(*) FILTER (method = '{m}') AS n_{m}" for m in ("judge", "paper_set", "no_answer")) + ", count(*) FILTER (parse IN ('empty', 'no_answer')) AS parse_failures FROM s")
def reward_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.reward_summary(_rewarded(spark, sf))


@query("SELECT doc_id, CASE WHEN lower(trim(v)) = 'correct' THEN 'Correct' ELSE 'Incorrect' END AS verdict FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' CORRECT' WHEN 1 THEN 'maybe' END AS v FROM labels)")
def verdict_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN ' CORRECT' WHEN 1 THEN 'maybe' END AS v").select("doc_id", text.verdict("v").alias("verdict"))


@query(f"WITH {_PRED}, m AS (SELECT {_ranking(5)} FROM pred) SELECT 'own' AS policy, 'ranking' AS bench, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(ndcg_5), 6) AS ndcg_5, 'v1' AS model, NULL::VARCHAR AS run FROM m")
def result_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.result_rows(evaluation.ranking_metrics(_predictions(spark, sf), (5,)), "own", "ranking", model="v1")
    return rows.select("policy", "bench", "n", F.col("metrics")["recall_5"].alias("recall_5"), F.col("metrics")["ndcg_5"].alias("ndcg_5"), "model", "run")


@query("SELECT count(*) AS n, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss FROM (SELECT value / 10 - 3 AS z, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS y FROM events WHERE event_id % 5 <> 0)")
def separation_loss(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "events").selectExpr("value / 10 - 3 AS log_z", "CASE WHEN user_id % 3 = 0 THEN -1.0 ELSE 0.5 END AS advantage", "event_id % 5 <> 0 AS mask")
    return evaluation.separation_loss(tokens)
