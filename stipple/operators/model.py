"""The data model: one row per node, ``(cloud_id, node_id, pos, ...)``; relations between nodes are tables.

- points: ``cloud_id, node_id, pos ARRAY<FLOAT|DOUBLE>`` and any attributes
- selection: ``cloud_id, node_id, sel_pos`` (ids only; applied by a join)
- edges: ``cloud_id, dst, rank, src, dist``

A row with a null ``cloud_id`` belongs to no set: operators that work on sets leave it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions.ranks import in_order


def as_points(df: DataFrame, node: str | Column, pos: Sequence[str | Column] | str, cloud: str | Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Points of any table: ``pos`` is an array column or a list of numeric columns; without ``cloud`` all rows are one set (0)."""

    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    at = F.col(pos) if isinstance(pos, str) else F.array(*[col(c).cast("double") for c in pos])
    where = F.lit(0).cast("long") if cloud is None else col(cloud)
    return df.select(where.alias("cloud_id"), col(node).alias("node_id"), at.alias("pos"), *keep)


def current_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], at: str = "received_at") -> DataFrame:
    """One row per key: of the rows with the latest ``at``, each value column's greatest non-null value.

    Rows that share a key and the latest instant differ at most in nulls and spelling, so a value is
    null only when it is null in all of them. Rows with a null key are dropped; a null ``at`` is the
    earliest instant. Values must be orderable.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    kept = [F.max(F.struct(F.col(at).alias("t"), F.col(v).alias("v"))).alias(v) for v in values]
    out = df.groupBy(*keys).agg(*kept)
    return out.select(*keys, *(F.col(v)["v"].alias(v) for v in values))


def finite(pos: Column, dims: int) -> Column:
    """Whether an array column has exactly ``dims`` finite elements."""
    bad = F.exists(pos, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(pos) == dims) & ~bad, F.lit(False))


def with_set_stats(df: DataFrame, stats: Sequence[Column], sets: Sequence[str] = ("cloud_id",)) -> DataFrame:
    """``df`` with aggregates of each row's set.

    A partial aggregate per task and one row per set, joined back: no set's rows are gathered. AQE
    broadcasts the sets when they are few and splits a large set when they are not.
    """
    if not sets:
        return df.crossJoin(F.broadcast(df.agg(*stats)))
    return df.join(df.groupBy(*sets).agg(*stats), list(sets))


def ptr(points: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """``(cloud_id, n, start)``: rows of each set and the rows of all sets before it; empty sets of ``sets`` keep a slot."""
    counts = points.groupBy("cloud_id").agg(F.count("*").alias("n"))
    if sets is not None:
        counts = sets.select("cloud_id").distinct().join(counts, "cloud_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return in_order(counts, ["cloud_id"], "start", value="n").select("cloud_id", "n", "start")


def filter_sets(points: DataFrame, sets: DataFrame, predicate: Column) -> DataFrame:
    """The points of the sets for which ``predicate`` (over the columns of ``sets``) is true."""
    return points.join(sets.filter(predicate).select("cloud_id").distinct(), "cloud_id", "left_semi")


def repeat_sets(df: DataFrame, times: int, when: Column | None = None) -> DataFrame:
    """Every row ``times`` times, numbered by ``loop``; rows for which ``when`` does not hold once."""
    loops = F.sequence(F.lit(0), F.lit(int(times) - 1))
    return df.withColumn("loop", F.explode(loops if when is None else F.when(when, loops).otherwise(F.array(F.lit(0)))))
