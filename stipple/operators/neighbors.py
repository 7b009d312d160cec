"""Nearest-neighbour and radius graphs.

Sets of few dimensions: a set is one task's work, in which only runs of points that a query's ball can
touch are ranked. A set of more than ``rows_per_task`` rows is cut into slabs of equal numbers of points
along its first feature; every query is ranked in its slab, and those whose ball reaches into others there too.

Sets of many dimensions are worked on in tiles: queries and points are cut into blocks of bounded size by a
hash of the node, each pair of blocks is one task's work, and partial lists are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.functions.kernels import matrix, near_k
from stipple.lineage import cut, written

_SLABS = 256
EDGES = "cloud_id {c}, dst long, rank int, src long, dist double"


def knn(points: DataFrame, k: int, queries: DataFrame | None = None, strict: bool = False, query_block: int = 4096, point_block: int = 16384, rows_per_task: int = 200_000) -> DataFrame:
    """``(cloud_id, dst, rank, src, dist)``: the k points of its set nearest to each query, rank 1 nearest.

    Without ``queries`` every point is one, itself included among its neighbours. Ties go to the smaller
    node. Sets with fewer than k points give fewer neighbours; ``strict`` raises for them, and for an
    empty query set. Distances are Euclidean, in double precision.
    """
    same = queries is None
    queries = points if same else queries
    if strict:
        short = points.groupBy("cloud_id").count().filter(F.col("count") < k)
        if short.limit(1).count():
            raise ValueError(f"a set has fewer than {k} points")
        if not queries.limit(1).count():
            raise ValueError("there are no queries")
    cloud_kind = points.schema["cloud_id"].dataType.simpleString()
    # Read several times below (sizes, queries, points), so written once.
    p = cut(points.select("cloud_id", F.col("node_id").cast("long").alias("node_id"), F.col("pos").cast("array<double>").alias("pos")))
    q = p if same else cut(queries.select("cloud_id", F.col("node_id").cast("long").alias("node_id"), F.col("pos").cast("array<double>").alias("pos")))
    flat = (p.agg(F.max(F.size("pos"))).first()[0] or 0) <= 4
    if flat:
        large = cut(p.groupBy("cloud_id").count().filter(F.col("count") > rows_per_task))
        if large.limit(1).count():
            some = _slabs(p.join(large, "cloud_id"), q.join(large.select("cloud_id"), "cloud_id", "left_semi"), k, cloud_kind, rows_per_task)
            p, q = (v.join(large.select("cloud_id"), "cloud_id", "left_anti") for v in (p, q))
            return some.unionByName(_tiles(p, q, k, cloud_kind, 10**9, 10**9, same))
        query_block = point_block = 10**9
    return _tiles(p, q, k, cloud_kind, query_block, point_block, same)


def _tiles(p: DataFrame, q: DataFrame, k: int, cloud_kind: str, query_block: int, point_block: int, same: bool) -> DataFrame:
    counts = p.groupBy("cloud_id").agg(F.ceil(F.count("*") / point_block).cast("int").alias("np"))
    if same:
        counts = p.groupBy("cloud_id").agg(F.ceil(F.count("*") / point_block).cast("int").alias("np"), F.ceil(F.count("*") / query_block).cast("int").alias("nq"))
    else:
        counts = counts.join(q.groupBy("cloud_id").agg(F.ceil(F.count("*") / query_block).cast("int").alias("nq")), "cloud_id")
    mine = F.xxhash64("node_id")
    left = q.join(counts, "cloud_id").withColumn("qb", F.pmod(mine, F.col("nq")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("np") - 1)))
    right = p.join(counts, "cloud_id").withColumn("pb", F.pmod(mine, F.col("np")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))

    def tile(lq: pa.Table, rp: pa.Table) -> pa.Table:
        if not len(lq) or not len(rp):
            lq = lq.slice(0, 0)
        ids, dst = rp["rn"].to_numpy(), lq["node_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, y = matrix(rp["rx"])[order], matrix(lq["pos"])
        step = max(1, 2_000_000 // max(1, len(ids))) if x.shape[1] > 4 else max(1, len(y))
        parts = [near_k(x, ids[order], y[i : i + step], k) for i in range(0, len(y), step)]
        near = np.concatenate([a for a, _ in parts]) if parts else np.zeros((0, 0), np.int64)
        d2 = np.concatenate([b for _, b in parts]) if parts else np.zeros((0, 0))
        w = near.shape[1]
        at = pa.array(np.repeat(np.arange(len(dst)), w))
        rank = np.tile(np.arange(1, w + 1, dtype=np.int32), len(dst))
        return pa.table([lq["lc"].take(at), lq["node_id"].take(at), pa.array(rank), pa.array(near.ravel().astype(np.int64)), pa.array(np.sqrt(d2.ravel())), lq["np"].take(at)], names=["cloud_id", "dst", "rank", "src", "dist", "np"])

    left = left.select(F.col("cloud_id").alias("lc"), F.col("qb").alias("lq"), F.col("pb").alias("lp"), "node_id", "pos", "np")
    right = right.select(F.col("cloud_id").alias("rc"), F.col("qb").alias("rq"), F.col("pb").alias("rp"), F.col("node_id").alias("rn"), F.col("pos").alias("rx"))
    found = left.groupBy("lc", "lq", "lp").cogroup(right.groupBy("rc", "rq", "rp"))
    found = found.applyInArrow(tile, EDGES.format(c=cloud_kind) + ", np int")
    whole = found.filter("np = 1").drop("np")
    best = F.row_number().over(Window.partitionBy("cloud_id", "dst").orderBy("dist", "src"))
    merged = found.filter("np > 1").withColumn("rank", best).filter(F.col("rank") <= k).drop("np")
    return whole.unionByName(merged)


def _slabs(p: DataFrame, q: DataFrame, k: int, cloud_kind: str, rows_per_task: int) -> DataFrame:
    """The same for large sets ``p(cloud_id, node_id, pos, count)`` of few dimensions: at most ``_SLABS`` slabs a set."""
    at = F.col("pos")[0]
    levels = [i / _SLABS for i in range(1, _SLABS)]
    ends = p.groupBy("cloud_id").agg(F.percentile_approx(at, levels, 10_000).alias("ends"), F.first("count").alias("count"))
    # As many slabs as the set needs: every so-many-th of the ends.
    every = F.greatest(F.lit(1), F.floor(F.lit(_SLABS) * rows_per_task / F.col("count")).cast("int"))
    ends = cut(ends.select("cloud_id", F.array_distinct(F.filter("ends", lambda v, i: (i + 1) % every == 0)).alias("ends")))
    slab = F.size(F.filter("ends", lambda v: v <= at))
    points = p.select("cloud_id", "node_id", "pos").join(ends, "cloud_id").select(F.col("cloud_id").alias("rc"), slab.alias("rs"), F.col("node_id").alias("rn"), F.col("pos").alias("rx"))
    asked = q.join(ends, "cloud_id").select("cloud_id", "node_id", "pos", "ends", slab.alias("own"))
    lists = f"cloud_id {cloud_kind}, node_id long, pos array<double>, own int, near array<long>, dist array<double>"

    def rank(lq: pa.Table, rp: pa.Table) -> pa.Table:
        m = len(lq)
        ids, y = rp["rn"].to_numpy(), matrix(lq["pos"])
        order = np.argsort(ids, kind="stable")
        upto = lq["upto"].to_numpy()
        near, d2 = near_k(matrix(rp["rx"])[order], ids[order], y, k, upto) if m and len(ids) else (np.zeros((m, 0), np.int64), np.zeros((m, 0)))
        valid = near >= 0
        ends_ = pa.array(np.append(0, np.cumsum(valid.sum(1))).astype(np.int32))
        return pa.table([lq["cloud_id"], lq["node_id"], lq["pos"], lq["own"], pa.ListArray.from_arrays(ends_, pa.array(near[valid])), pa.ListArray.from_arrays(ends_, pa.array(d2[valid]))], names=["cloud_id", "node_id", "pos", "own", "near", "dist"])

    def search(asking: DataFrame) -> DataFrame:
        return asking.groupBy("cloud_id", "slab").cogroup(points.groupBy("rc", "rs")).applyInArrow(rank, lists)

    first = written(search(asked.select("cloud_id", "node_id", "pos", "own", F.col("own").alias("slab"), F.lit(float("inf")).alias("upto"))))
    # A list with k neighbours bounds the ball (distances are squared until the end); slabs that it touches besides the own one are asked too.
    upto = F.when(F.size("dist") >= k, F.element_at("dist", -1)).otherwise(F.lit(float("inf")))
    ball = first.join(ends, "cloud_id").withColumn("upto", upto)
    reach = F.sqrt("upto") * (1 + 1e-9)
    low, high = F.size(F.filter("ends", lambda v: v < at - reach)), F.size(F.filter("ends", lambda v: v <= at + reach))
    more = ball.withColumn("slab", F.explode(F.sequence(low, high))).filter("slab <> own").select("cloud_id", "node_id", "pos", "own", "slab", "upto")
    every_list = first.unionByName(search(more)).select("cloud_id", F.col("node_id").alias("dst"), F.explode(F.arrays_zip("near", "dist")).alias("v"))
    pairs = every_list.select("cloud_id", "dst", F.col("v.near").alias("src"), F.col("v.dist").alias("dist"))
    best = F.row_number().over(Window.partitionBy("cloud_id", "dst").orderBy("dist", "src"))
    return pairs.withColumn("rank", best).filter(F.col("rank") <= k).select("cloud_id", "dst", "rank", "src", F.sqrt("dist").alias("dist"))


def knn_window(points: DataFrame, k: int, dims: int, queries: DataFrame | None = None) -> DataFrame:
    """The same by a join on the set and a window: for small sets and for checking the kernel."""
    queries = points if queries is None else queries
    a = queries.select("cloud_id", F.col("node_id").alias("dst"), F.col("pos").cast("array<double>").alias("a"))
    b = points.select("cloud_id", F.col("node_id").alias("src"), F.col("pos").cast("array<double>").alias("b"))
    total = F.lit(0.0)
    for d in range(dims):
        total = total + F.pow(F.col("a")[d] - F.col("b")[d], 2)
    pairs = a.join(b, "cloud_id").select("cloud_id", "dst", "src", F.sqrt(total).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("cloud_id", "dst").orderBy("dist", "src"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("cloud_id", "dst", "rank", "src", "dist")


def source_graph(points: DataFrame, k: int = 25) -> DataFrame:
    """``(cloud_id, node_id, neighbors)``: each node's neighbours as an array, nearest (itself) first."""
    return to_dense(knn(points, k))


def to_dense(edges: DataFrame) -> DataFrame:
    """Edges as one array of sources per node, by rank."""
    row = F.array_sort(F.collect_list(F.struct("rank", "src")))
    return edges.groupBy("cloud_id", F.col("dst").alias("node_id")).agg(row.alias("r")).select("cloud_id", "node_id", F.col("r.src").alias("neighbors"))


def to_coo(dense: DataFrame) -> DataFrame:
    """``(cloud_id, src, dst)``: one row per neighbour and node."""
    return dense.select("cloud_id", F.explode("neighbors").alias("src"), F.col("node_id").alias("dst"))


def ball_graph(points: DataFrame, r: float, max_neighbors: int = 32) -> DataFrame:
    """``(cloud_id, src, dst)``: nodes closer than ``r`` among the ``max_neighbors`` nearest, the node itself always."""
    return knn(points, max_neighbors).filter(F.col("dist") < r).select("cloud_id", "src", "dst")


def nearest_selection(points: DataFrame, selection: DataFrame) -> DataFrame:
    """``(cloud_id, node_id, cluster)``: for each node, the position in the selection of the nearest selected node."""
    chosen = points.join(selection.select("cloud_id", "node_id", "sel_pos"), ["cloud_id", "node_id"])
    near = knn(chosen, 1, queries=points).select("cloud_id", F.col("dst").alias("node_id"), F.col("src").alias("chosen"))
    at = selection.groupBy("cloud_id", F.col("node_id").alias("chosen")).agg(F.min("sel_pos").alias("cluster"))
    return near.join(at, ["cloud_id", "chosen"]).select("cloud_id", "node_id", "cluster")
