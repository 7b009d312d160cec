"""Density estimated from the distance to the k-th neighbour."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.operators.neighbors import knn
from stipple.operators.apply import apply_selection
from stipple.operators.select import random_select

K = 15


def unit_ball(d: int) -> float:
    return math.pi ** (d / 2) / math.gamma(1 + d / 2)


def estimate_density(points: DataFrame, pointwise: bool = True, estimation_factor: float = 0.05, d: int = 2, exponent: int = 2, subsample: bool = False, seed: int = 0) -> DataFrame:
    """``(cloud_id, node_id, density)``, or per set its mean if not ``pointwise``.

    ``density = k / (estimation_factor * V_d * r ** exponent)`` with r the distance to the 15th other
    point. By default r is measured among all points and the exponent is 2; ``subsample=True`` measures
    it among a random ``estimation_factor`` of them, ``exponent=d`` uses the dimension. Null where r is 0
    or the set has no 15 other points.
    """
    base = points
    if subsample:
        base = apply_selection(points, random_select(points, selection_factor=estimation_factor, min_num_points=K + 1, seed=seed))
    r = knn(base, K + 1, queries=points if subsample else None).filter(F.col("rank") == K + 1)
    value = F.lit(K / estimation_factor / unit_ball(d)) / F.pow("dist", F.lit(float(exponent)))
    out = r.select("cloud_id", F.col("dst").alias("node_id"), F.when(F.col("dist") > 0, value).alias("density"))
    out = points.select("cloud_id", F.col("node_id").cast("long").alias("node_id")).join(out, ["cloud_id", "node_id"], "left")
    return out if pointwise else out.groupBy("cloud_id").agg(F.avg("density").alias("density"))
