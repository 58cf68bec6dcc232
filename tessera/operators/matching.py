"""Bipartite matching of two populations with three thresholds.

Core edges are each set record's nearest mutual neighbour; extras are other
close edges of either side.  A target may serve several set records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_STAGES = {"core": 0, "set_extra": 1, "target_extra": 2}


def edges(there: DataFrame, back: DataFrame, most: float) -> DataFrame:
    """(set_id, target_id, distance) of both directions within ``most``, the least per pair."""
    a = there.select(F.col("src_id").alias("set_id"), F.col("nbr_id").alias("target_id"), "distance")
    b = back.select(F.col("nbr_id").alias("set_id"), F.col("src_id").alias("target_id"), "distance")
    return a.unionByName(b).where(F.col("distance") <= most).groupBy("set_id", "target_id").agg(F.min("distance").alias("distance"))


def _top(neighbours: DataFrame, k: int, src: str, nbr: str, mark: str) -> DataFrame:
    w = W.partitionBy("src_id").orderBy("distance", "nbr_id")
    ranked = neighbours.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return ranked.select(F.col("src_id").alias(src), F.col("nbr_id").alias(nbr), F.lit(True).alias(mark))


def resolve(there: DataFrame, back: DataFrame, k: int = 5, one_to_one: float | None = 0.2, one_to_many: float | None = None, many_to_one: float | None = None) -> DataFrame:
    """(set_id, target_id, distance, stage): matched edges, each in its first stage.

    A threshold of None turns its stage off.  Membership of a top k is not cut by
    the thresholds, only edges are.
    """
    active = [t for t in (one_to_one, one_to_many, many_to_one) if t is not None]
    found = edges(there, back, max(active, default=-1.0))
    found = found.join(_top(there, k, "set_id", "target_id", "s"), ["set_id", "target_id"], "left")
    found = found.join(_top(back, k, "target_id", "set_id", "t"), ["set_id", "target_id"], "left")
    mutual = F.coalesce(F.col("s") & F.col("t"), F.lit(False))
    near = mutual & (F.col("distance") <= (-1.0 if one_to_one is None else one_to_one))
    w = W.partitionBy("set_id").orderBy((~near).cast("int"), "distance", "target_id")
    core = near & (F.row_number().over(w) == 1)
    stage = F.when(core, "core")
    if one_to_many is not None:
        stage = stage.when(F.col("s") & (F.col("distance") <= one_to_many), "set_extra")
    if many_to_one is not None:
        stage = stage.when(F.col("t") & (F.col("distance") <= many_to_one), "target_extra")
    return found.withColumn("stage", stage).where("stage is not null").select("set_id", "target_id", "distance", "stage")


def unmatched(points: DataFrame, matched: DataFrame, column: str) -> DataFrame:
    """Ids of points that no matched edge has in ``column``."""
    return points.select(F.col("doc_id").alias(column)).distinct().join(matched.select(column), column, "left_anti")


def stats(matched: DataFrame, set_only: DataFrame, target_only: DataFrame) -> DataFrame:
    """One row of counters."""
    by = [F.count_if(F.col("stage") == s).alias(f"{s}_edges") for s in _STAGES]
    out = matched.agg(F.count("*").alias("edges"), *by, F.countDistinct("set_id").alias("matched_set"), F.countDistinct("target_id").alias("matched_target"))
    return out.crossJoin(set_only.agg(F.count("*").alias("set_only"))).crossJoin(target_only.agg(F.count("*").alias("target_only")))
