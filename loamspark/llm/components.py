"""Connected components and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import shared


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster names in spark.checkpoint.dir.

    Only where the session names none, and is on one machine (tests), a temporary folder is set.
    """
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared.base(spark))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (u, v), both long.

    Alternating large-star and small-star steps until the edges form stars; their number grows
    with the logarithm of the longest path. Each step cuts its lineage.
    """
    edges = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    of_u = Window.partitionBy("u")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(of_u))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u > v").distinct()
        small = down.withColumn("m", F.min("v").over(of_u))
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        edges = checkpointed(stars)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
