"""Ordered delivery of items in batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stipple.functions import rng
from stipple.functions.ranks import in_order


def batches(items: DataFrame, key: Sequence[str], batch_size: int = 1, shuffle: bool = False, drop_last: bool = False, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``items`` with ``position`` in the order of the pass, ``batch_id`` and ``batch_pos``.

    The order is that of ``key`` (unique), or a new random one for each epoch. ``drop_last`` leaves out
    an incomplete last batch. Positions come from a range partitioning, not from one task.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    if shuffle:
        keyed = items.withColumn("__u", rng.uniform(seed, f"epoch{epoch}", *key))
        placed = in_order(keyed, ["__u", *key], "position").drop("__u")
    else:
        placed = in_order(items, list(key), "position")
    if drop_last:
        total = placed.agg((F.floor(F.count("*") / batch_size) * batch_size).alias("__n"))
        placed = placed.crossJoin(F.broadcast(total)).filter(F.col("position") < F.col("__n")).drop("__n")
    return placed.withColumn("batch_id", F.floor(F.col("position") / batch_size)).withColumn("batch_pos", F.col("position") % batch_size)


def deliver(batched: DataFrame) -> Iterator[list[Row]]:
    """Batches one after another, strictly in order; partitions are fetched ahead while one is consumed.

    The consumer holds one batch and at most two partitions. Errors of a task surface at the consumer.
    """
    rows = batched.repartitionByRange("batch_id", "batch_pos").sortWithinPartitions("batch_id", "batch_pos")
    held: list[Row] = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        if held and row["batch_id"] != held[0]["batch_id"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held
