"""Column expressions for retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_form, is_number, plain_number


def recall(retrieved: Column, relevant: Column) -> Column:
    """Distinct hits over the number of relevant ids, repeats included; 0 if there is none."""
    hits = F.size(F.array_intersect(retrieved, relevant))
    return F.when(F.coalesce(F.size(relevant), F.lit(0)) > 0, hits / F.size(relevant)).otherwise(F.lit(0.0))


def gain(retrieved: Column, relevant: Column) -> Column:
    """Gain of 1 over the place of each hit, as a share of the best order's; repeats count again."""
    at = F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / (i + 1)).otherwise(F.lit(0.0)))
    total = F.aggregate(at, F.lit(0.0), lambda s, x: s + x)
    n = F.size(relevant)
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, x: s + 1.0 / x)
    return F.when(F.coalesce(n, F.lit(0)) > 0, total / best).otherwise(F.lit(0.0))


def dcg(grades: Column) -> Column:
    """Sum of grade over the natural log of place + 1, places from 1."""
    return F.aggregate(F.transform(grades, lambda g, i: g.cast("double") / F.ln(i + 2)), F.lit(0.0), lambda s, x: s + x)


def rank_score(grades: Column) -> Column:
    """Where the order of the grades lies between their worst and their best order."""
    hi, lo = dcg(F.sort_array(grades, False)), dcg(F.sort_array(grades))
    flat = F.when(hi > 0, 1.0).otherwise(0.0)
    inner = F.when(F.array_max(grades) == F.array_min(grades), flat).otherwise((dcg(grades) - lo) / F.when(hi != lo, hi - lo))
    return F.when(F.coalesce(F.size(grades), F.lit(0)) == 0, 0.0).otherwise(inner)


def harmonic(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 2 * a * b / F.nullif(a + b, F.lit(0.0))).otherwise(F.lit(0.0))


def recall_at_total(grades: Column, total: Column) -> Column:
    """Of the first `total` predictions, those of grade 3 over total; 0 if total is 0."""
    first = F.slice(grades, F.lit(1), F.greatest(total, F.lit(0)).cast("int"))
    return F.when(total > 0, F.size(F.filter(first, lambda g: g >= 3)) / total).otherwise(F.lit(0.0))


def gaia_correct(answer: Column, gold: Column) -> Column:
    """A number is compared as a number, a list element by element, anything else by its compact form; the gold decides."""
    number = plain_number(answer) == F.translate(gold, "_", "").try_cast("double")
    a, g = F.split(answer, "[,;]"), F.split(gold, "[,;]")
    same = F.zip_with(a, g, lambda x, y: F.when(is_number(y), plain_number(x) == F.translate(y, "_", "").try_cast("double")).otherwise(F.lower(compact_spaces(x)) == F.lower(compact_spaces(y))))
    listed = (F.size(a) == F.size(g)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))
    plain = compact_form(answer) == compact_form(gold)
    return F.coalesce(F.when(is_number(gold), number).when(gold.rlike("[,;]"), listed).otherwise(plain), F.lit(False))


def compact_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def f_score(correct: Column, incorrect: Column, total: Column) -> Column:
    """Harmonic mean of the share that is correct and the share of the attempted that is."""
    c, given = correct / F.greatest(total, F.lit(1)), correct / F.greatest(correct + incorrect, F.lit(1))
    return harmonic(c.cast("double"), given.cast("double"))
