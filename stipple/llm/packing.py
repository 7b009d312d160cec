"""Filling containers of fixed capacity with items of varying length (optimal length buckets).

1. Items longer than the capacity give full pieces, each a container of its own, and a remainder.
2. A global histogram of the remaining lengths (at most one entry per length up to the capacity) goes
   to the driver. Dynamic programming over it chooses the bucket boundaries with the least padding.
3. Inside and across the buckets, token-budget batches are planned on counts alone: a container takes
   from the largest bucket with items left, then the largest bucket that still fits its budget, and so
   on; one such pattern is laid out for as many containers as the counts allow.
4. Every item gets its rank in its bucket (ranks are counted per salt and offset, so no bucket is one
   task) and from it, by a search in the plan, its container.

The driver holds counts per length and patterns, never items.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.llm.common import cut


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = 256, resolution: int = 1024) -> np.ndarray:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    Lengths are counted in at most ``resolution`` classes of equal width before the search; the last
    bound is the largest class that occurs. Exact for capacities up to ``resolution``.
    """
    width = -(-capacity // resolution)
    cls, inverse = np.unique(-(-lengths // width), return_inverse=True)
    n = np.bincount(inverse, weights=counts)
    m = len(cls)
    if m <= buckets:
        return np.minimum(cls * width, capacity)
    below = np.append(0.0, np.cumsum(n))
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    back = np.zeros((buckets + 1, m + 1), np.int32)
    # cost[i, j]: classes i..j-1 share the bound of class j-1; the sum of true lengths is a constant
    i, j = np.arange(m)[:, None], np.arange(1, m + 1)[None, :]
    cost = np.where(i < j, cls[j - 1] * (below[j] - below[i]), np.inf)
    for k in range(1, buckets + 1):
        total = best[:m, None] + cost
        at = np.argmin(total, axis=0)
        step = total[at, np.arange(m)]
        back[k, 1:] = at
        best = np.append(np.inf, step)
    cuts, at = [], m
    for k in range(buckets, 0, -1):
        cuts.append(at)
        at = int(back[k, at])
        if at == 0:
            break
    return np.minimum(cls[np.array(cuts[::-1]) - 1] * width, capacity)


@dataclass
class Plan:
    """Runs of containers with one pattern. Run i: ranks [lo, hi) of a bucket go, ``per`` at a time, to containers from ``first`` on."""

    bucket: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    per: np.ndarray
    first: np.ndarray
    containers: int


def plan_batches(bounds: Sequence[int], counts: Sequence[int], capacity: int) -> Plan:
    """Token-budget batches over bucket counts: largest bucket first, then what still fits the budget."""
    bounds = np.asarray(bounds, np.int64)
    left = np.asarray(counts, np.int64).copy()
    used = np.zeros_like(left)
    rows, containers = [], 0
    while left.any():
        room, pattern = capacity, {}
        j = int(np.flatnonzero(left)[-1])
        while j >= 0:
            if left[j] and bounds[j] <= room:
                take = int(min(room // max(1, bounds[j]), left[j]))
                pattern[j] = take
                room -= take * int(bounds[j])
            j = min(j, int(np.searchsorted(bounds, room, side="right"))) - 1
        times = min(int(left[b]) // m for b, m in pattern.items())
        for b, m in pattern.items():
            rows.append((b, used[b], used[b] + m * times, m, containers))
            used[b] += m * times
            left[b] -= m * times
        containers += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, containers)


def pack(items: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", size_col: str = "n_tokens", buckets: int = 256, rows_per_rank_task: int = 200_000, seed: int = 7) -> DataFrame:
    """``(budget_id, container_id, id, piece, start_at, n_units)``: every item in one container per capacity.

    An item is split only if it alone exceeds the capacity: into full pieces, which fill a container
    each, and a remainder, which is packed like an item. Empty and null sizes need no room: one row
    with a null container. Items are rows: repeated ids are packed separately. An empty table gives an
    empty result. ``capacities`` (budget id -> capacity) is a driver-side table of fixed size; the
    histogram sent to the driver has at most sum(capacity) rows. Other columns are ignored.
    """
    spark = items.sparkSession
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    caps = F.create_map(*[F.lit(int(x)) for kv in capacities.items() for x in kv])
    sized = cut(items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("n")))
    each = sized.withColumn("budget_id", F.explode(F.array(*[F.lit(int(b)) for b in capacities])))
    each = each.withColumn("cap", caps[F.col("budget_id")].cast("long")).withColumn("full", F.floor(F.col("n") / F.col("cap"))).withColumn("rest", F.col("n") % F.col("cap"))

    rest = each.filter("rest > 0").select("budget_id", "id", F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("start_at"), F.col("rest").alias("n_units"))
    histogram = rest.groupBy("budget_id", "n_units").count().toPandas()

    bound_of: dict[int, np.ndarray] = {}
    plans: dict[int, Plan] = {}
    most = 1
    for b, cap in capacities.items():
        h = histogram[histogram.budget_id == b]
        lengths, counts = h.n_units.to_numpy(np.int64), h["count"].to_numpy(np.int64)
        bounds = bucket_bounds(lengths, counts, cap, buckets) if len(h) else np.array([cap])
        per = np.bincount(np.searchsorted(bounds, lengths), weights=counts, minlength=len(bounds)).astype(np.int64) if len(h) else np.zeros(1, np.int64)
        bound_of[b], plans[b] = bounds, plan_batches(bounds, per, cap)
        most = max(most, int(per.max()))
    salts = -(-most // rows_per_rank_task) * 4

    @F.pandas_udf(T.IntegerType())
    def bucket_of(budget: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int32)
        for b in budget.unique():
            at = (budget == b).to_numpy()
            out[at] = np.searchsorted(bound_of[int(b)], size[at].to_numpy())
        return pd.Series(out)

    @F.pandas_udf(T.LongType())
    def container_of(budget: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), np.int64)
        for b in budget.unique():
            at, p = (budget == b).to_numpy(), plans[int(b)]
            key = p.bucket << 40 | p.lo
            run = np.searchsorted(key, bucket[at].to_numpy(np.int64) << 40 | rank[at].to_numpy(np.int64), side="right") - 1
            out[at] = p.first[run] + (rank[at].to_numpy(np.int64) - p.lo[run]) // p.per[run]
        return pd.Series(out)

    keyed = rest.withColumn("bucket", bucket_of("budget_id", "n_units")).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(salts)).cast("int"))
    group = ["budget_id", "bucket", "salt"]
    sizes = keyed.groupBy(*group).count()
    before = Window.partitionBy("budget_id", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("n_units", "id", "piece")) - 1)
    ranked = ranked.join(offsets, group).withColumn("rank", F.col("r") + F.col("offset"))
    packed = ranked.select("budget_id", container_of("budget_id", "bucket", "rank").alias("container_id"), "id", "piece", "start_at", "n_units")

    # Full pieces get containers of their own, numbered after the planned ones.
    full = each.filter("full > 0")
    salt = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(salts)).cast("int")
    per = full.groupBy("budget_id", salt.alias("salt")).agg(F.sum("full").alias("count"))
    before = Window.partitionBy("budget_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select("budget_id", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    planned = F.create_map(*[F.lit(int(x)) for b, p in plans.items() for x in (b, p.containers)])
    prior = Window.partitionBy("budget_id", "salt").orderBy("id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("salt", salt).withColumn("mine", F.coalesce(F.sum("full").over(prior), F.lit(0))).join(start, ["budget_id", "salt"])
    placed = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    pieces = placed.select("budget_id", (planned[F.col("budget_id")] + F.col("offset") + F.col("mine") + F.col("piece")).cast("long").alias("container_id"), "id", "piece", (F.col("piece") * F.col("cap")).alias("start_at"), F.col("cap").alias("n_units"))

    nothing = each.filter("n = 0").select("budget_id", F.lit(None).cast("long").alias("container_id"), "id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start_at"), F.lit(0).cast("long").alias("n_units"))
    return packed.unionByName(pieces).unionByName(nothing).withColumnRenamed("id", id_col)
