"""Voxel binning and one node per voxel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import rng
from stipple.functions.ranks import in_order
from stipple.functions.vectors import parts
from stipple.operators.select import cluster_select


def _voxels(points: DataFrame, size: Column, dims: int) -> DataFrame:
    """Points with ``v0..``: cell indices from the minimum over all points."""
    p = parts("pos", dims)
    low = points.agg(*[F.min(x).alias(f"__lo{d}") for d, x in enumerate(p)])
    out = points.withColumn("__s", size).crossJoin(F.broadcast(low))
    for d, x in enumerate(p):
        out = out.withColumn(f"v{d}", F.floor((x - F.col(f"__lo{d}")) / F.col("__s")))
    return out.drop("__s", *[f"__lo{d}" for d in range(dims)])


def voxel_cluster(points: DataFrame, voxel_size: float | tuple[float, float], dims: int = 3, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Points with ``cluster``: dense numbers of the occupied voxels, by set, then last dimension first.

    A tuple is a range each set draws its voxel size from. The occupied voxels are aggregated and
    numbered, then joined back.
    """
    size = rng.between(*voxel_size, seed, f"voxel{epoch}", "cloud_id") if isinstance(voxel_size, tuple) else F.lit(float(voxel_size))
    v = _voxels(points, size, dims)
    key = ["cloud_id", *[f"v{d}" for d in reversed(range(dims))]]
    numbered = in_order(v.select(*key).distinct(), key, "cluster")
    return v.join(numbered, key).select(*points.columns, "cluster")


def voxel_select(points: DataFrame, voxel_size: float | tuple[float, float] = 1.0, deterministic: bool = False, pick: int | None = None, large_voxel_prob: float = 0.5, dims: int = 3, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Selection of one node per voxel: number ``pick mod size`` by node id, or a random one.

    With a tuple of sizes a set uses the low one, or with ``large_voxel_prob`` one drawn from the range.
    Voxels need no numbers here, so nothing is sorted.
    """
    if isinstance(voxel_size, tuple):
        drawn = rng.between(*voxel_size, seed, f"voxel{epoch}", "cloud_id")
        size = F.when(rng.bernoulli(large_voxel_prob, seed, f"large{epoch}", "cloud_id"), drawn).otherwise(F.lit(float(voxel_size[0])))
    else:
        size = F.lit(float(voxel_size))
    key = ("cloud_id", *[f"v{d}" for d in range(dims)])
    return cluster_select(_voxels(points, size, dims), deterministic, (epoch % 12) if pick is None else pick, seed, epoch, key)
