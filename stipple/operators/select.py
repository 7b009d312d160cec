"""Selection operators: each gives a ``selection(cloud_id, node_id, sel_pos)`` relation of ids only.

``sel_pos`` is the 0-based position of the node in the selection. ``apply.apply_selection`` gathers.
Sizes are ``trunc(n * factor)`` in double precision, clamped to the limits and to the set's size. Random
choices order nodes by a hash of (seed, epoch, set, node), so they are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import rng
from stipple.functions.kernels import farthest, matrix
from stipple.functions.ranks import id_bucket, log_bucket, ranked, unit_bucket
from stipple.functions.vectors import parts
from stipple.lineage import cut


def _sizes(points: DataFrame, factor: Column, most: int, least: int, capped: bool = True) -> DataFrame:
    """``(cloud_id, n, size)`` of every set."""
    counts = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    size = F.greatest(F.least((F.col("n").cast("double") * factor).cast("long"), F.lit(int(most))), F.lit(int(least)))
    return counts.withColumn("size", F.least(size, F.col("n")) if capped else size)


def block_select(points: DataFrame, max_num_points: int = 10**9, min_num_points: int = 1, selection_factor: float = 1.0) -> DataFrame:
    """The first nodes of each set, by node id."""
    ids = points.select("cloud_id", "node_id")
    sizes = _sizes(ids, F.lit(float(selection_factor)), max_num_points, min_num_points)
    placed = ranked(ids, ["cloud_id"], ["node_id"], "sel_pos", id_bucket("node_id"))
    return placed.join(sizes, "cloud_id").filter(F.col("sel_pos") < F.col("size")).select("cloud_id", "node_id", "sel_pos")


def _ascending(chosen: DataFrame) -> DataFrame:
    return ranked(chosen, ["cloud_id"], ["node_id"], "sel_pos", id_bucket("node_id")).select("cloud_id", "node_id", "sel_pos")


def random_select(points: DataFrame, max_num_points: int = 10**7, selection_factor: float | tuple[float, float] = 1.0, min_num_points: int = 1, replacement: bool = False, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Uniformly chosen nodes of each set, by ascending node id.

    A tuple of factors is a range each set draws its factor from. With ``replacement`` a set's size may
    exceed its rows and nodes may repeat.
    """
    ids = points.select("cloud_id", "node_id")
    factor = rng.between(*selection_factor, seed, f"factor{epoch}", "cloud_id") if isinstance(selection_factor, tuple) else F.lit(float(selection_factor))
    sizes = _sizes(ids, factor, max_num_points, min_num_points, capped=not replacement)
    if replacement:
        draws = sizes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
        draws = draws.withColumn("i", F.floor(rng.uniform(seed, f"draw{epoch}", "cloud_id", "j") * F.col("n")))
        placed = ranked(ids, ["cloud_id"], ["node_id"], "i", id_bucket("node_id"))
        drawn = draws.select("cloud_id", "i", "j").join(placed, ["cloud_id", "i"])
        return ranked(drawn, ["cloud_id"], ["node_id", "j"], "sel_pos", id_bucket("node_id")).select("cloud_id", "node_id", "sel_pos")
    u = rng.uniform(seed, f"pick{epoch}", "cloud_id", "node_id")
    order = ranked(ids.withColumn("u", u), ["cloud_id"], ["u", "node_id"], "r", unit_bucket(F.col("u")))
    return _ascending(order.join(sizes, "cloud_id").filter(F.col("r") < F.col("size")).select("cloud_id", "node_id"))


def random_point_dropout(points: DataFrame, max_dropout: float = 0.9, p: float = 1.0, seed: int = 0, epoch: int = 0) -> DataFrame:
    """For each set with probability ``p``, a share of its nodes between ``1 - max_dropout`` and 1; else all."""
    ids = points.select("cloud_id", "node_id")
    keep = F.lit(1.0) - rng.uniform(seed, f"ratio{epoch}", "cloud_id") * F.lit(float(max_dropout))
    factor = F.when(rng.bernoulli(p, seed, f"drop{epoch}", "cloud_id"), keep).otherwise(F.lit(1.0))
    u = rng.uniform(seed, f"pick{epoch}", "cloud_id", "node_id")
    order = ranked(ids.withColumn("u", u), ["cloud_id"], ["u", "node_id"], "r", unit_bucket(F.col("u")))
    chosen = order.join(_sizes(ids, factor, 10**12, 1), "cloud_id").filter(F.col("r") < F.col("size"))
    return _ascending(chosen.select("cloud_id", "node_id"))


def radius_select(points: DataFrame, max_num_points: int, max_radius: float = float("inf"), max_ratio: float = 1.0, sort_by_distance: bool = False, deterministic: bool = False, dims: int = 3, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Per set, the nodes nearest to a centre node (the first, or a random one), closer than ``max_radius``.

    At most ``min(trunc(n * max_ratio), max_num_points)`` nodes. Sets that need no reduction pass whole.
    Ordered by node id, or from the centre out if ``sort_by_distance``.
    """
    u = F.lit(0.0) if deterministic else rng.uniform(seed, f"centre{epoch}", "cloud_id", "node_id")
    p = parts("pos", dims)
    slim = points.select("cloud_id", "node_id", *[x.alias(f"p{d}") for d, x in enumerate(p)], u.alias("u"))
    here = F.struct("u", "node_id", *[f"p{d}" for d in range(dims)])
    sets = slim.groupBy("cloud_id").agg(F.count("*").alias("n"), F.min(here).alias("c"))
    most = F.least((F.col("n").cast("double") * F.lit(float(max_ratio))).cast("long"), F.lit(int(max_num_points)))
    d2 = F.lit(0.0)
    for d in range(dims):
        d2 = d2 + F.pow(F.col(f"p{d}") - F.col(f"c.p{d}"), 2)
    far = slim.join(sets.withColumn("most", most), "cloud_id").select("cloud_id", "node_id", "n", "most", F.sqrt(d2).alias("dist"))
    far = far.withColumn("all", F.col("n") <= F.col("most") if max_radius == float("inf") else F.lit(False))
    close = far.filter(F.col("all") | (F.col("dist") < F.lit(float(max_radius))))
    near = ranked(close, ["cloud_id"], ["dist", "node_id"], "r", log_bucket("dist"))
    near = near.filter(F.col("all") | (F.col("r") < F.col("most")))
    if sort_by_distance:
        return near.select("cloud_id", "node_id", F.col("r").alias("sel_pos"))
    return _ascending(near.select("cloud_id", "node_id"))


sphere_select = radius_select


def cluster_select(points: DataFrame, deterministic: bool = False, pick: int | None = None, seed: int = 0, epoch: int = 0, key: tuple[str, ...] = ("cloud_id", "cluster")) -> DataFrame:
    """One node per cluster: number ``pick mod size`` by node id if deterministic, else a random one.

    Without ``pick`` the epoch is used, so that repeated passes go through a cluster's nodes.
    """
    ids = points.select("node_id", *dict.fromkeys(("cloud_id", *key)))
    if deterministic:
        n = F.lit(int(epoch if pick is None else pick))
        sizes = ids.groupBy(*key).agg(F.count("*").alias("m"))
        rows = ranked(ids, list(key), ["node_id"], "i", id_bucket("node_id")).join(sizes, list(key))
        chosen = rows.filter(F.col("i") == n % F.col("m"))
    else:
        u = rng.uniform(seed, f"cluster{epoch}", "cloud_id", "node_id")
        best = F.max_by("node_id", F.struct(u.alias("u"), F.col("node_id"))).alias("node_id")
        chosen = ids.groupBy(*dict.fromkeys(("cloud_id", *key))).agg(best)
    return _ascending(chosen.select("cloud_id", "node_id"))


def fps_select(points: DataFrame, max_num_points: int = 10**7, selection_factor: float = 1.0, min_num_points: int = 1, deterministic: bool = True, seed: int = 0, epoch: int = 0, rows_per_set: int = 1_000_000) -> DataFrame:
    """Farthest-point sampling per set, in the order of the picks; the first is the first or a random node.

    Sets above ``rows_per_set`` rows are sampled in rounds over the whole table instead of in one task.
    """
    size = F.greatest(F.least((F.col("n").cast("double") * F.lit(float(selection_factor))).cast("long"), F.lit(int(max_num_points))), F.lit(int(min_num_points)))
    counts = points.groupBy("cloud_id").agg(F.count("*").alias("n")).withColumn("size", F.least(size, F.col("n")))
    start = F.lit(0.0) if deterministic else rng.uniform(seed, f"fps{epoch}", "cloud_id", "node_id")
    rows = points.select("cloud_id", F.col("node_id").cast("long").alias("node_id"), F.col("pos").cast("array<double>").alias("pos"), start.alias("u")).join(counts, "cloud_id")
    kind = points.schema["cloud_id"].dataType.simpleString()

    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        ids, u = t["node_id"].to_numpy(), t["u"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x = matrix(t["pos"])[order]
        picks = farthest(x, int(t["size"][0].as_py()), int(np.argmin(u[order])))
        cloud = t["cloud_id"].take(pa.array(np.zeros(len(picks), np.int64)))
        return pa.table([cloud, pa.array(ids[order][picks]), pa.array(np.arange(len(picks)))], names=["cloud_id", "node_id", "sel_pos"])

    shape = f"cloud_id {kind}, node_id long, sel_pos long"
    large = cut(counts.filter(F.col("n") > rows_per_set).select("cloud_id"))
    if not large.limit(1).count():
        return rows.groupBy("cloud_id").applyInArrow(run, shape)
    out = rows.join(large, "cloud_id", "left_anti").groupBy("cloud_id").applyInArrow(run, shape)
    return out.unionByName(_fps_rounds(rows.join(large, "cloud_id", "left_semi"), shape))


def _fps_rounds(rows: DataFrame, shape: str) -> DataFrame:
    """One pick per round for all large sets at once: an aggregate finds it, a join lowers the distances."""
    state = cut(rows.withColumn("d", F.lit(float("inf"))))
    most = state.agg(F.max("size")).first()[0] or 0
    picked = None
    for i in range(int(most)):
        first = F.struct(-F.col("d"), F.col("u") if i == 0 else F.col("node_id"), F.col("node_id"))
        best = cut(state.filter(F.col("size") > i).groupBy("cloud_id").agg(F.min_by(F.struct("node_id", "pos"), first).alias("b")))
        pick = best.select("cloud_id", F.col("b.node_id").alias("node_id"), F.lit(i).cast("long").alias("sel_pos"))
        picked = pick if picked is None else picked.unionByName(pick)
        d2 = F.aggregate(F.zip_with("pos", F.col("b.pos"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        state = state.join(F.broadcast(best), "cloud_id").withColumn("d", F.when(F.col("node_id") == F.col("b.node_id"), F.lit(-1.0)).otherwise(F.least("d", d2))).drop("b")
        if i % 10 == 9:
            state, picked = cut(state), cut(picked)
    return picked if picked is not None else rows.sparkSession.createDataFrame([], shape)


def inverse_density_select(points: DataFrame, density: str = "density", seed: int = 0, epoch: int = 0) -> DataFrame:
    """All nodes in the order of drawing without replacement with weight 1 / density.

    ``sel_pos`` is a node's place in that order: read in node order it is the permutation, sorted by it
    the ordered selection.
    """
    key = -F.log(rng.open_uniform(seed, f"inverse{epoch}", "cloud_id", "node_id")) * F.col(density).cast("double")
    keyed = points.select("cloud_id", "node_id", key.alias("key"))
    return ranked(keyed, ["cloud_id"], ["key", "node_id"], "sel_pos", log_bucket("key")).select("cloud_id", "node_id", "sel_pos")
