"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo), hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = F.least("u", F.min("v").over(W.partitionBy("u")))
    large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    large = large.distinct()
    least = F.min("lo").over(W.partitionBy("hi"))
    starred = large.withColumn("m", least)
    return (
        starred.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        .select("e.*")
        .where("hi > lo")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node.

    Self loops, nulls and repeated edges are ignored.  Every round is written
    to shared storage; rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark)
    current = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = current.distinct()
    before = None
    turn = 0
    while True:
        current = written(_stars(current), f"{folder}/{turn}")
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        turn += 1
    return current.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
