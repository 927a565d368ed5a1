"""Column expressions over dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its Euclidean length, which counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def placeholder(sparse: Column) -> Column:
    """A sparse vector; an empty or null one gets a dummy term that a store accepts."""
    return F.when(F.coalesce(F.size(sparse), F.lit(0)) > 0, sparse).otherwise(F.create_map(F.lit(0).cast("long"), F.lit(1e-9).cast("float")))


def hash_encoding(terms: Column, dim: int = 32) -> Column:
    """A unit vector of a list of terms, without a model: each term adds or takes 1 at a place that its hash names.

    Null for no terms, and where all cancel out. For tests and baselines; a place goes through all terms, so dim is small.
    """
    code = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
    marks = F.transform(terms, lambda t: F.struct((code(t) % dim).alias("at"), F.when((code(t) / dim).cast("long") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(marks, lambda m: m["at"] == i), F.lit(0.0), lambda a, m: a + m["sign"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm))
