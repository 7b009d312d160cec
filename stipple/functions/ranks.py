"""Positions and running sums that no single task has to compute alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.lineage import cut, partitions


_SPREAD = 1 << 22


def ranked(df: DataFrame, sets: Sequence[str], order: Sequence[Column | str], name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in its set.

    ``bucket`` must not decrease along ``order``. Rows are sorted within (set, bucket) and a bucket's
    position starts where the smaller ones end, so a large set is sorted by as many tasks as it has
    buckets. Without ``bucket`` a set is one task. ``df`` should be narrow: it is read twice, and so
    written once before.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*sets).orderBy(*order)) - 1)
    keyed = cut(df.withColumn("__b", bucket))
    ends = keyed.agg(F.max("__b") - F.min("__b")).first()[0]
    if ends is not None and ends > _SPREAD:
        # Ids that are hashes: buckets of a set are joined so that it has no more than its rows call for.
        span = keyed.groupBy(*sets).agg(F.min("__b").alias("__l"), F.max("__b").alias("__h"), F.count("*").alias("__c"))
        wide = F.greatest(F.lit(1.0), (F.col("__h").cast("double") - F.col("__l")) / F.ceil(F.col("__c") / F.lit(65_536.0)))
        keyed = keyed.join(span, list(sets)) if sets else keyed.crossJoin(F.broadcast(span))
        keyed = cut(keyed.withColumn("__b", F.floor((F.col("__b").cast("double") - F.col("__l")) / wide).cast("long")).drop("__l", "__h", "__c"))
    counts = keyed.groupBy(*sets, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*sets).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*sets, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*sets, "__b").orderBy(*order)) - 1)
    return local.join(offsets, [*sets, "__b"]).withColumn(name, F.col("__r") + F.col("__o")).drop("__b", "__n", "__r", "__o")


def id_bucket(key: str) -> Column:
    """A bucket that does not decrease with an integer id and holds at most 65,536 different ids."""
    return F.coalesce(F.shiftright(F.col(key).cast("long"), 16), F.lit(0).cast("long"))


def unit_bucket(u: Column, buckets: int = 64) -> Column:
    """A bucket that does not decrease with a number spread over [0, 1)."""
    return F.floor(u * F.lit(float(buckets))).cast("int")


def log_bucket(key: str, per_octave: int = 4) -> Column:
    """A bucket that does not decrease with a real number: its octave and the part of it."""
    v = F.least(F.col(key), F.lit(1e300))
    octave = F.floor(F.log2(v) * F.lit(float(per_octave))).cast("int")
    ends = F.when(F.col(key).isNull(), F.lit(-1_000_002)).when(F.isnan(F.col(key)), F.lit(1_000_000))
    return ends.when(v > 0, octave).when(v == 0, F.lit(-1_000_000)).otherwise(F.lit(-1_000_001))


def in_order(df: DataFrame, order: Sequence[str], name: str, value: str | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of all rows; with ``value``, the sum of it over the rows before.

    The rows are range-partitioned and sorted; a partition's positions start where the ones before end.
    Only one row per partition is summed over.
    """
    n = partitions(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    placed = placed.withColumn("__p", F.shiftright("__m", 33))
    amount = F.sum(value) if value else F.count("*")
    sums = placed.groupBy("__p").agg(amount.alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o")))
    if value:
        own = F.coalesce(F.sum(value).over(Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        own = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__i", own).join(offsets, "__p").withColumn(name, F.col("__i") + F.col("__o")).drop("__m", "__p", "__i", "__o")
