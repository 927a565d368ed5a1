"""Operator 5: mixing sources to target weights by Pareto order sampling.

A source's share of all copies is its weight over the weights of the sources that are there; its
number of copies T is that share of `fraction` times the number of documents, rounded. Within a
source a document of size measure x (the whole square root of n_chars, at least 1) has an expected
number of copies mu = T * x / X, X being the source's sum of x. The whole part of mu is certain:
so many copies are allocated first. What is left of T is a sample of fixed size in which a document
is included with the rest of mu as its odds: documents are ranked by q, their random odds
u / (1 - u) over their inclusion odds, and the least are taken. Shares are exact in whole numbers,
and each document's number of copies is the whole part of mu or one more.

Random numbers are a hash of seed and doc_id, so a run can be repeated and an executor lost. No
source is sorted whole: q is counted in BINS ranges, and only the range in which the sample ends is
ranked. Rows don't move but for that: each source's few numbers are broadcast, if there are no more
than BROADCAST_SOURCES of them.

Texts aren't looked at, so very long ones are rows like others. A null source is a source of its own, of the default weight. A null or negative n_chars counts as 0.
A null doc_id gets the random number of an empty text. Repeated rows count each, share their random
number, and are ranked in any order among themselves, being equal. An empty table gives an empty
result. Other columns, whatever their names, are carried along by `mixed` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import checkpointed

#: The weights of sources; any other has DEFAULT.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
DEFAULT = 1.0
FRACTION = 1.0
SEED = 17
BINS = 4096
#: Up to so many sources their few numbers are broadcast; beyond, they are joined like any table.
BROADCAST_SOURCES = 100_000


def uniform(seed: int) -> Column:
    """A number strictly between 0 and 1 from a hash of seed and doc_id, the same in other engines."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _prepared(docs: DataFrame, weights: dict[str, float], default: float, fraction: float, seed: int) -> DataFrame:
    """docs with the certain copies in __copies, q and its range, and where the source's sample ends: range and rows of it."""
    size = F.greatest(F.floor(F.sqrt(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))), F.lit(1)).cast("long")
    # a null source is kept apart from one that is named ''
    base = docs.withColumns({"__source": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "__id": F.col("doc_id"), "__x": size})
    named = F.regexp_replace("__source", "^=", "")
    sums = checkpointed(base.groupBy("__source").agg(F.count(F.lit(1)).alias("__n"), F.sum("__x").alias("__sum")).withColumn("__w", _weight(named, weights, default)))
    few = sums.count() <= BROADCAST_SOURCES
    total = sums.agg(F.sum("__n").alias("__all"), F.sum("__w").alias("__ws"))
    targets = sums.crossJoin(total).select("__source", "__sum", F.floor(F.col("__w") / F.col("__ws") * F.floor(F.lit(float(fraction)) * F.col("__all")) + 0.5).cast("long").alias("__t"))
    joined = base.join(F.broadcast(targets) if few else targets, "__source")
    joined = joined.withColumns({"__copies": F.expr("__t * __x div __sum"), "__rest": F.expr("__t * __x % __sum")})
    u = uniform(seed)
    q = (u * (F.col("__sum") - F.col("__rest"))) / ((1.0 - u) * F.col("__rest"))
    joined = joined.withColumn("__q", F.when(F.col("__rest") > 0, q))
    joined = joined.withColumn("__bin", F.when(F.col("__rest") > 0, F.floor(F.col("__q") / (1.0 + F.col("__q")) * BINS)).otherwise(-1).cast("long"))
    hist = joined.groupBy("__source", "__bin").agg(F.count(F.lit(1)).alias("__k"), F.sum("__copies").alias("__c"), F.first("__t").alias("__t"))
    whole = Window.partitionBy("__source")
    upto = whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    drawn = F.when(F.col("__bin") >= 0, F.col("__k")).otherwise(0)
    hist = hist.withColumns({"__left": F.col("__t") - F.sum("__c").over(whole), "__upto": F.sum(drawn).over(upto), "__k": drawn})
    cut = hist.filter("__left > 0 and __upto >= __left and __upto - __k < __left").select("__source", F.col("__bin").alias("__cut"), (F.col("__left") - F.col("__upto") + F.col("__k")).alias("__room"))
    return joined.join(F.broadcast(cut) if few else cut, "__source", "left")


def _weight(named: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(named == name, F.lit(float(w))).otherwise(out)
    return out


def copies(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """docs with __copies, the number of copies (0 too) of each row; its other helper columns begin with __."""
    ready = _prepared(docs, WEIGHTS if weights is None else weights, default, fraction, seed)
    sure = ready.filter("__cut is null or __bin <> __cut").withColumn("__copies", F.col("__copies") + F.when((F.col("__bin") >= 0) & (F.col("__bin") < F.col("__cut")), 1).otherwise(0))
    order = Window.partitionBy("__source").orderBy("__q", F.asc_nulls_last("__id"), F.asc_nulls_last("n_chars"))
    edge = ready.filter("__bin = __cut").withColumn("__nth", F.row_number().over(order)).withColumn("__copies", F.col("__copies") + F.when(F.col("__nth") <= F.col("__room"), 1).otherwise(0)).drop("__nth")
    return sure.unionByName(edge)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as it has copies, with docs' columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # none clashes with a helper column
    plain = docs.toDF(*names)
    at = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "source", "n_chars")}
    out = copies(plain.withColumns(at)).filter("__copies > 0")
    return out.withColumn("__one", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return copies(docs).filter("__copies > 0").select("doc_id", "source", "n_chars", F.col("__copies").alias("copies"))


_CASE = " ".join(f"WHEN source = '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items())
ORACLE_SQL = f"""
WITH a AS (SELECT doc_id, source, n_chars, greatest(floor(sqrt(greatest(coalesce(n_chars, 0), 0)::DOUBLE))::BIGINT, 1) AS x,
  (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, count(*) AS n, sum(x)::BIGINT AS sx, CASE {_CASE} ELSE {DEFAULT}::DOUBLE END AS w FROM a GROUP BY source),
t AS (SELECT source, sx, floor(w / sum(w) OVER () * floor({FRACTION}::DOUBLE * sum(n) OVER ()) + 0.5)::BIGINT AS t FROM s),
m AS (SELECT a.*, t.t, (t.t * x) // sx AS c, (t.t * x) % sx AS rest, sx FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN rest > 0 THEN (u * (sx - rest)) / ((1.0 - u) * rest) END AS q, (t - sum(c) OVER (PARTITION BY source))::BIGINT AS left_ FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, n_chars NULLS LAST) AS nth FROM q)
SELECT doc_id, source, n_chars, c + CASE WHEN rest > 0 AND nth <= left_ THEN 1 ELSE 0 END AS copies FROM r WHERE c + CASE WHEN rest > 0 AND nth <= left_ THEN 1 ELSE 0 END > 0
"""
