"""Samples that follow target category shares, by swap repair on signature counts.

A record's signature is its tuple of category values. The sample is first decided on counts: a random
sample of the wanted size that satisfies the floors, then exchanges of single counts between
signatures while one lowers the deviation from the targets. Only then are records drawn, at random
within each signature, as many as its count says. The driver holds one count per listed signature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repaired_counts(eligible: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Counts per signature: random start satisfying the floors, repaired by swaps until none improves.

    ``target`` are wanted counts (not rounded). A floor above what is eligible is met as far as it goes.
    The deviation is the sum of squared differences from the targets; an exchange takes counts from a
    signature above its floor and gives them to one with records left, as many at once as lower the deviation
    most. The best pair is found directly, and none is left that improves by a single count, so the result
    is a local and, the deviation being convex, global optimum for the size. The number of exchanges does
    not grow with the counts.
    """
    rng = np.random.default_rng(seed)
    low = np.minimum(floor, eligible).astype(np.int64)
    size = int(min(max(size, low.sum()), eligible.sum()))
    free = eligible - low
    # The generator takes fewer than 10^9 records; more are drawn in units, the rest of a unit at random.
    unit = 1 + int(free.sum()) // 900_000_000
    room = free // unit
    have = low + rng.multivariate_hypergeometric(room, min((size - int(low.sum())) // unit, int(room.sum()))) * unit
    for i in rng.permutation(len(have)):
        have[i] += min(size - int(have.sum()), int(eligible[i] - have[i]))
    while True:
        gain_add = np.where(have < eligible, 2 * (target - have) - 1, -np.inf)
        gain_drop = np.where(have > low, 2 * (have - target) - 1, -np.inf)
        a, d = int(np.argmax(gain_add)), int(np.argmax(gain_drop))
        if a == d or not gain_add[a] + gain_drop[d] > 1e-9:
            return have
        block = round(((target[a] - have[a]) + (have[d] - target[d])) / 2)
        block = int(max(1, min(block, eligible[a] - have[a], have[d] - low[d])))
        have[a] += block
        have[d] -= block


class QuotaSample:
    """Sample of ``records`` whose shares of ``signature`` follow ``targets``.

    ``targets`` has the ``strata`` columns (samples are drawn for each stratum separately), the other
    ``signature`` columns, ``target_share``, ``min_rows`` and ``sample_share``; it lists every category
    and must be a table of fixed size. Records with a null or unlisted signature are not eligible.
    A stratum with no eligible records gives an empty sample and all its rows are reported.
    """

    def __init__(self, records: DataFrame, targets: DataFrame, signature: Sequence[str], strata: Sequence[str], id_col: str, seed: int = 7, max_targets: int = 100_000):
        self.signature, self.strata, self.id_col, self.seed = list(signature), list(strata), id_col, seed
        if targets.limit(max_targets + 1).count() > max_targets:
            raise ValueError(f"more than {max_targets} targets")
        self._listed = F.broadcast(targets.select(*self.signature).dropDuplicates())
        self.records = records.join(self._listed, self.signature, "left_semi")
        self.targets = targets

    def counts(self):
        """One row per target: eligible records, wanted rows, and the rows the sample takes (a pandas frame)."""
        counted = self.records.groupBy(*self.signature).agg(F.count("*").alias("eligible"))
        t = self.targets.toPandas().merge(counted.toPandas(), how="left", on=self.signature)
        t["eligible"] = t["eligible"].fillna(0).astype("int64")
        t["n"] = t.groupby(self.strata, dropna=False)["eligible"].transform("sum")
        t["wanted"] = t.target_share * t.sample_share * t.n
        t["required"] = np.maximum(t.wanted, t.min_rows)
        t["sampled"] = 0
        for _, g in t.groupby(self.strata, dropna=False):
            size = int(round(float(g.wanted.sum())))
            t.loc[g.index, "sampled"] = repaired_counts(g.eligible.to_numpy(), g.wanted.to_numpy(), g.min_rows.to_numpy(), size, self.seed)
        return t

    def report(self) -> DataFrame:
        """Targets with ``eligible``, ``required`` (the larger of the wanted rows and the floor), ``sampled`` and ``met``."""
        t = self.counts()
        # A target is missed if the sample falls short of it by more than there is left to take.
        t["met"] = t.required - t.sampled <= t.eligible - t.sampled
        cols = [*self.signature, "target_share", "min_rows", "eligible", "required", "sampled", "met"]
        kinds = {f.name: f.dataType.simpleString() for f in self.targets.schema} | {"eligible": "bigint", "required": "double", "sampled": "bigint", "met": "boolean"}
        rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in t[cols].itertuples(index=False)]
        return self.records.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {kinds[c]}" for c in cols))

    def sample(self) -> DataFrame:
        """The sampled records. Within a signature they are those with the smallest hashes of ``id_col`` and seed.

        The smallest are found by a histogram of hash prefixes per signature: whole prefixes below the
        boundary are taken, only the boundary prefix is ranked, so no signature becomes one task.
        """
        t = self.counts()[[*self.signature, "sampled"]]
        kinds = {f.name: f.dataType.simpleString() for f in self.targets.schema}
        rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in t.itertuples(index=False)]
        wanted = F.broadcast(self.records.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {kinds[c]}" for c in self.signature) + ", sampled bigint"))
        mixed: Column = F.xxhash64(self.id_col, F.lit(self.seed))
        keyed = self.records.withColumn("__h", mixed).withColumn("__p", F.shiftrightunsigned("__h", 52))
        prefix = keyed.groupBy(*self.signature, "__p").agg(F.count("*").alias("__n"))
        upto = Window.partitionBy(*self.signature).orderBy("__p")
        prefix = prefix.withColumn("__sum", F.sum("__n").over(upto)).join(wanted, self.signature)
        prefix = prefix.withColumn("__room", F.col("sampled") - (F.col("__sum") - F.col("__n"))).filter("__room > 0").select(*self.signature, "__p", "__n", "__room")
        taken = keyed.join(prefix, [*self.signature, "__p"])
        whole = taken.filter("__n <= __room")
        rank = Window.partitionBy(*self.signature, "__p").orderBy("__h", self.id_col)
        part = taken.filter("__n > __room").withColumn("__r", F.row_number().over(rank)).filter("__r <= __room").drop("__r")
        return whole.unionByName(part).drop("__h", "__p", "__n", "__room")
