"""Operator 2: quality rules whose cutoffs are selected on labelled holdouts under a risk bound.

A rule rejects a text if its measure is above the rule's cutoff for the text's stratum (its lang).
Cutoffs are not given but selected, for each stratum and rule:

* Labelled rows (quality 1 is good, 0 is bad) are all counted: how many good and bad ones each
  candidate cutoff would reject.
* A cutoff is certified if, were the true rate of false rejection above ALPHA / rules, so few
  rejected good rows as were seen would have a probability of at most DELTA / (strata * rules):
  the exact binomial (Clopper-Pearson) bound with Bonferroni's correction over strata and rules.
  Candidates are tested from lenient to strict, stopping at the first that fails (fixed-sequence
  testing), so trying many costs nothing.
* Of the certified, the one that rejects most bad rows counts, a false rejection costing
  FALSE_COST rows, and the most lenient of equals. A rule without such a cutoff rejects nothing.

So with probability 1 - DELTA every stratum loses at most ALPHA of its good texts to the rules
together. A stratum with too few labels for a bound keeps everything.

Null, empty and blank texts are rejected (`empty`). A null lang is the stratum ''. A row whose
doc_id is null has no label and is judged as any other; repeated rows are judged alike, and each
label of a doc_id counts. Very long texts are measured whole. Of cutoffs of equal worth the most lenient
is taken; a measure equal to a cutoff isn't above it. Labels other than 0 and 1 count for nothing. Empty tables give empty
results. Other columns, whatever their names, are carried along by `kept` and not looked at.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import checkpointed

ALPHA, DELTA, FALSE_COST = 0.05, 0.1, 10
RULES = ("shout", "symbols", "pipes", "capitals", "repeats", "brevity")
#: Candidate cutoffs from lenient to strict.
CUTOFFS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)
WORD = r"[^\x00-\x20]+"


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with n_words and the measures of RULES, each named with the prefix."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    words = prefix + "words"
    df = df.withColumn(words, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    w, n = F.col(words), F.size(words)
    per_word = lambda count: count / F.greatest(n, F.lit(1))
    again = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    of = {
        "n_words": n.cast("long"),
        "shout": per_word(F.regexp_count(t, F.lit("!"))),
        "symbols": per_word(F.regexp_count(t, F.lit("[#$%&*]"))),
        "pipes": per_word(F.regexp_count(t, F.lit(r"\|"))),
        "capitals": F.regexp_count(t, F.lit(r"\p{Lu}")) / F.greatest(F.length(t), F.lit(1)),
        "repeats": per_word(again),
        "brevity": F.lit(1.0) / F.greatest(n, F.lit(1)),
    }
    return df.withColumns({prefix + k: v for k, v in of.items()}).drop(words)


def stratum(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of n trials."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=np.float64)
    # log of n over i, by summing the logs of ratios of neighbours
    steps = np.append(0.0, np.cumsum(np.log((n - i[:-1]) / (i[:-1] + 1))))
    return float(min(1.0, np.exp(steps + i * log(p) + (n - i) * np.log1p(-p)).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The Clopper-Pearson upper bound of a rate of which k of n were seen."""
    lo, hi = 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or tail(k, n, mid) > delta else (lo, mid)
    return hi


def select(good: int, false: list[int], caught: list[int], alpha: float, delta: float) -> float | None:
    """The cutoff for one stratum and rule, or None."""
    best, most = None, 0
    for c, f, b in zip(CUTOFFS, false, caught):
        # more false rejections than the rate expects can't pass; nor need their tail be summed
        if good == 0 or f > alpha * good or tail(f, good, alpha) > delta:
            break
        if b - FALSE_COST * f > most:
            best, most = c, b - FALSE_COST * f
    return best


def thresholds(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule, from counts over all labelled rows."""
    return _select_all(measures(docs.select("doc_id", "lang", "text")), labels, "", alpha, delta)


def _select_all(measured: DataFrame, labels: DataFrame, prefix: str, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs from measured rows; at most 180 counts a stratum come to the driver."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    joined = measured.select("doc_id", stratum(F.col("lang")).alias("stratum"), *[F.col(prefix + r).alias(r) for r in RULES]).join(marked, "doc_id")
    exceeded = lambda r: sum(((F.col(r) > c).cast("int") for c in CUTOFFS), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), exceeded(r).alias("over")) for r in RULES])).alias("m")
    rows = joined.select("stratum", "quality", each).groupBy("stratum", "quality", "m.rule", "m.over").agg(F.count(F.lit(1)).alias("n")).collect()
    strata = sorted({row["stratum"] for row in rows})
    tests = len(strata) * len(RULES)
    found: dict[str, dict[str, float]] = {s: {} for s in strata}
    for s in strata:
        for r in RULES:
            over = {q: {row["over"]: row["n"] for row in rows if (row["stratum"], row["quality"], row["rule"]) == (s, q, r)} for q in (0, 1)}
            # a measure above the i-th cutoff is above all that follow
            above = {q: [sum(n for k, n in over[q].items() if k >= len(CUTOFFS) - i) for i in range(len(CUTOFFS))] for q in (0, 1)}
            c = select(sum(over[1].values()), above[1], above[0], alpha / len(RULES), delta / tests)
            if c is not None:
                found[s][r] = c
    return found


def failed(cutoffs: dict[str, dict[str, float]], stratum_: Column, prefix: str = "") -> Column:
    """The names of the rules that reject a measured row, in the order of RULES, parted by commas.

    A rule's cutoffs are looked up in one map of strata, so the plan doesn't grow with them.
    """
    names = [F.when(F.col(prefix + "n_words") == 0, F.lit("empty"))]
    for rule in RULES:
        of = {s: c[rule] for s, c in sorted(cutoffs.items()) if rule in c}
        if of:
            cutoff = F.try_element_at(F.map_from_arrays(F.lit(list(of)), F.lit(list(of.values()))), stratum_)
            names.append(F.when((F.col(prefix + "n_words") > 0) & (F.col(prefix + rule) > cutoff), F.lit(rule)))
    return F.concat_ws(",", *names)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, failed and keep for every row of docs. Texts are read once: the measures are written and read twice."""
    measured = checkpointed(measures(docs.select("doc_id", "lang", "text")).drop("text"))
    out = measured.withColumn("failed", failed(_select_all(measured, labels, ""), stratum(F.col("lang"))))
    return out.select("doc_id", "lang", "n_words", "failed", (F.col("failed") == "").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns. Measured once: rows are written with their measures."""
    p = "__" + "_" * max([0, *map(len, docs.columns)])  # longer than any name, so none clashes
    measured = checkpointed(measures(docs, prefix=p))
    return measured.filter(failed(_select_all(measured, labels, p), stratum(F.col("lang")), p) == "").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _oracle() -> str:
    ratio = {
        "shout": "len(regexp_extract_all(t, '!')) / greatest(n, 1)",
        "symbols": "len(regexp_extract_all(t, '[#$%&*]')) / greatest(n, 1)",
        "pipes": r"len(regexp_extract_all(t, '\|')) / greatest(n, 1)",
        "capitals": r"len(regexp_extract_all(t, '\p{Lu}')) / greatest(length(t), 1)",
        "repeats": "len(list_filter(range(2, n + 1), lambda i: w[i] = w[i - 1])) / greatest(n, 1)",
        "brevity": "1.0::DOUBLE / greatest(n, 1)",
    }
    rows = "\nUNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, {r}::DOUBLE AS v FROM labelled" for r in RULES)
    reject = " || ".join(f"CASE WHEN n > 0 AND {r}::DOUBLE > (SELECT max(cutoff) FROM chosen c WHERE c.stratum = m.s AND c.rule = '{r}') THEN ',{r}' ELSE '' END" for r in RULES)
    k = len(RULES)
    return rf"""
WITH a AS (SELECT doc_id, lang, coalesce(lang, '') AS s, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x00-\x20]+') AS w FROM documents),
b AS (SELECT *, len(w) AS n FROM a),
m AS (SELECT doc_id, lang, s, n, {", ".join(f"{e} AS {r}" for r, e in ratio.items())} FROM b),
labelled AS (SELECT m.*, s AS stratum, l.quality FROM m JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)),
long AS ({rows}),
cut AS (SELECT i, ([{", ".join(map(str, CUTOFFS))}]::DOUBLE[])[i] AS c FROM range(1, {len(CUTOFFS) + 1}) r(i)),
counts AS (SELECT stratum, rule, i, c, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND v > c) AS false_, count(*) FILTER (quality = 0 AND v > c) AS caught FROM long CROSS JOIN cut GROUP BY ALL),
tests AS (SELECT count(DISTINCT stratum) * {k} AS n FROM counts),
p AS (SELECT *, good > 0 AND false_ <= {ALPHA / k!r}::DOUBLE * good AND coalesce(list_sum(list_transform(range(0, CASE WHEN false_ <= {ALPHA / k!r}::DOUBLE * good THEN false_ + 1 ELSE 0 END), lambda x:
  exp(lgamma(good + 1) - lgamma(x + 1) - lgamma(good - x + 1) + x * ln({ALPHA / k!r}::DOUBLE) + (good - x) * ln(1 - {ALPHA / k!r}::DOUBLE)))), 1) <= {DELTA}::DOUBLE / (SELECT n FROM tests) AS passed FROM counts),
certified AS (SELECT *, caught - {FALSE_COST} * false_ AS worth, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM p),
chosen AS (SELECT stratum, rule, arg_max(c, worth * 1000 - i) AS cutoff FROM certified WHERE ok AND worth > 0 GROUP BY ALL),
f AS (SELECT doc_id, lang, n AS n_words, (CASE WHEN n = 0 THEN ',empty' ELSE '' END) || {reject} AS names FROM m)
SELECT doc_id, lang, n_words, substr(names, 2) AS failed, names = '' AS keep FROM f
"""


ORACLE_SQL = _oracle()
