"""Groups of vectors linked by steps of at most a given reach, by density clustering on a grid.

1. The features with the largest spread are quantised into cells much wider than the reach. Each row goes
   to its own cell, and to the cell below if it is within reach of the border to it, so two linked rows
   always meet in a cell.
2. Cells are counted. A cell with more rows than one task should hold is quantised again, by the feature in
   which it extends farthest, until it is small or no wider than a few reaches in any feature.
3. A dense cell that cannot be divided has pivots drawn from it: all rows within reach of one are one group
   at once. Only the few rows left over are compared with the others, block by block; they form a smaller
   cell, for which the same is done.
4. In every other cell groups are found exactly, each named by its smallest id, without a list of pairs.
5. Rows at borders carry a name from each of their cells: these join the groups of adjacent cells. Minimum
   labels are propagated over the joins in SQL until nothing changes.

Links, labels and groups stay distributed; one row of column statistics and a few counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.llm.common import cut, written

_PIVOTS = 48
_SMALL = 256


def linked(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component under the given links, starting from ``label``."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def within(a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Whether each row of ``a`` is within reach of each row of ``b``; pairs at the border are measured exactly."""
    mid = b.mean(0) if len(b) else 0.0
    x, y = a - mid, b - mid
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    d = x @ (-2.0 * y.T)
    d += nx[:, None]
    d += ny
    slack = 1e-9 * max(1.0, float(nx.max(initial=0.0)), float(ny.max(initial=0.0)))
    out = d <= reach * reach
    i, j = np.nonzero(np.abs(d - reach * reach) <= slack)
    out[i, j] = ((a[i] - b[j]) ** 2).sum(1) <= reach * reach
    return out


def any_within(a: np.ndarray, b: np.ndarray, reach: float, block: int = 2_000_000) -> np.ndarray:
    """For each row of ``b``, the index of the first row of ``a`` within reach, or -1."""
    out = np.full(len(b), -1)
    step = max(1, block // max(1, len(b)))
    for lo in range(0, len(a), step):
        left = np.flatnonzero(out < 0)
        if not len(left):
            break
        hit = within(a[lo : lo + step], b[left], reach)
        found = hit.any(0)
        out[left[found]] = hit.argmax(0)[found] + lo
    return out


def _by_pivots(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all groups of rows that lie close together.

    A pivot takes in all free rows within reach of it. A link between two rows either is one to a pivot or
    joins a row taken in by a pivot to one within twice the reach of that pivot: only those are compared.
    """
    owner = np.full(len(x), -1)
    near_pivot: list[np.ndarray] = []
    a, b = [], []
    pivots: list[int] = []
    free = np.arange(len(x))
    while len(free):
        p = int(free[0])
        d = np.sqrt(((x - x[p]) ** 2).sum(1))
        mine = d <= reach
        a.append(np.flatnonzero(mine))
        b.append(np.full(int(mine.sum()), p))
        owner[mine & (owner < 0)] = p
        near_pivot.append(np.flatnonzero((d > reach) & (d <= 2.0 * reach * (1 + 1e-9))))
        pivots.append(p)
        free = np.flatnonzero(owner < 0)
    label = linked(np.concatenate(a), np.concatenate(b), np.arange(len(x)))
    for p, near in zip(pivots, near_pivot, strict=True):
        near = near[label[near] != label[p]]
        mine = np.flatnonzero(owner == p)
        if len(near):
            hit = any_within(x[mine], x[near], reach)
            label = linked(mine[hit[hit >= 0]], near[hit >= 0], label)
    return np.arange(len(x)), label


def local_groups(x: np.ndarray, reach: float) -> np.ndarray:
    """Group of each row: index of the group's first row. Exact single linkage at ``reach``.

    Rows are divided at planes that few rows are near; rows within reach above a plane go to both sides,
    so linked rows stay together somewhere. Small parts are compared pair by pair, parts that no plane
    divides by pivots.
    """
    a, b = [], []
    todo = [np.arange(len(x))]
    while todo:
        part = todo.pop()
        n = len(part)
        if n < 2:
            continue
        if n <= _SMALL:
            hit = within(x[part], x[part], reach)
            label = np.arange(n)
            while True:
                new = np.where(hit, label[None], n).min(1)
                new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
            a.append(part)
            b.append(part[label])
            continue
        low, high = x[part].min(0), x[part].max(0)
        best = None
        for d in np.argsort(low - high, kind="stable")[:3]:
            if high[d] - low[d] <= reach:
                break
            v = np.sort(x[part, d])
            at = v[(n * np.arange(6, 19)) // 25]
            upto, beyond = np.searchsorted(v, at, side="right"), np.searchsorted(v, at + reach * (1 + 1e-9), side="right")
            cost = np.where(upto < n, np.maximum(beyond, n - upto), n)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = (int(cost[i]), int(d), float(at[i]))
        if best is None or best[0] > 0.85 * n:
            i, j = _by_pivots(x[part], reach)
            a.append(part[i])
            b.append(part[j])
            continue
        v = x[part, best[1]]
        todo += [part[v <= best[2] + reach * (1 + 1e-9)], part[v > best[2]]]
    return linked(np.concatenate(a), np.concatenate(b), np.arange(len(x))) if a else np.arange(len(x))


def propagate(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(label, least)`` for every label in ``edges(keys.., a, b)``: the smallest label of its component.

    Rounds of neighbourhood minima with label jumping, in SQL, each cut by a checkpoint; the number of
    rounds grows with the logarithm of a component's diameter.
    """
    keys = [c for c in edges.columns if c not in ("a", "b")]
    both = cut(edges.union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy(*keys, F.col("a").alias("label")).agg(F.least(F.first("a"), F.min("b")).alias("least")))
    for _ in range(max_rounds):
        near = both.join(state.withColumnRenamed("label", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("label")).agg(F.min("least").alias("m"))
        jump = state.select(*keys, F.col("label").alias("least"), F.col("least").alias("j"))
        new = state.join(near, [*keys, "label"]).join(jump, [*keys, "least"], "left")
        new = cut(new.select(*keys, "label", F.least("least", "m", "j").alias("least"), (F.least("least", "m", "j") < F.col("least")).alias("changed")))
        state = new.drop("changed")
        if not new.filter("changed").limit(1).count():
            return state
    raise RuntimeError("labels did not converge")


def _matrix(col: pa.ChunkedArray, dims: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _copied(rows: DataFrame, at: Column, width: Column, reach: float) -> DataFrame:
    """``rows`` with the cell divided by ``at`` (in cells): each in its own and, within reach of its lower border, in the one below."""
    low = F.floor(at)
    both = ((at - low) * width) <= F.lit(reach * (1 + 1e-9))
    cells = F.when(both, F.array(low, low - 1)).otherwise(F.array(low))
    out = rows.withColumn("c", F.explode(cells)).withColumn("several", F.col("several") | both)
    return out.withColumn("cell", F.xxhash64("cell", "c")).drop("c")


def _divided(placed: DataFrame, keys: list[str], dims: int, reach: float, rows_per_task: int, rounds: int = 40) -> tuple[list[DataFrame], DataFrame | None]:
    """Rows whose cells one task can hold, and those of dense cells that no feature divides (None if there are none)."""
    ready, dense = [], None
    group = [*keys, "cell"]
    for _ in range(rounds):
        hot = placed.groupBy(*group).agg(F.count("*").alias("rows")).filter(F.col("rows") > rows_per_task)
        hot = cut(hot)
        if not hot.limit(1).count():
            return [*ready, placed], dense
        ready.append(placed.join(hot, group, "left_anti"))
        ends = placed.join(hot.select(*group), group, "left_semi").groupBy(*group).agg(*[f(F.col("pos")[d]).cast("double").alias(f"{n}{d}") for d in range(dims) for n, f in (("l", F.min), ("h", F.max))])
        extent = F.array_max(F.array(*[F.struct((F.col(f"h{d}") - F.col(f"l{d}")).alias("e"), F.lit(d).alias("d"), F.col(f"l{d}").alias("l")) for d in range(dims)]))
        ends = cut(ends.select(*group, extent.alias("x")).select(*group, F.col("x.d").alias("d"), F.col("x.l").alias("l"), F.greatest(F.col("x.e") / 4, F.lit(2.0 * reach)).alias("w"), (F.col("x.e") > 4.0 * reach).alias("wide")))
        stuck = placed.join(ends.filter("not wide").select(*group), group, "left_semi")
        if ends.filter("not wide").limit(1).count():
            dense = stuck if dense is None else dense.unionByName(stuck)
        if not ends.filter("wide").limit(1).count():
            return ready, dense
        parts = placed.join(ends.filter("wide"), group)
        at = (F.col("pos")[F.col("d")].cast("double") - F.col("l")) / F.col("w")
        placed = written(_copied(parts, at, F.col("w"), reach).select(*placed.columns))
    raise RuntimeError("cells cannot be divided")


def _dense(rows: DataFrame, keys: list[str], dims: int, reach: float, rows_per_task: int, seed: int, rounds: int = 40) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Names of rows of dense cells, joins of labels, and the rows left over that one task can hold.

    A round: pivots are drawn from each cell; rows within reach of the pivots of the largest linked set of
    them are one group. The others are compared with that group in blocks of it, and go to the next round.
    """
    group = [*keys, "cell"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in group)
    named, joins, ready = [], [], None
    columns = rows.columns
    rows = written(rows)
    for r in range(rounds):
        counts = rows.groupBy(*group).agg(F.count("*").alias("rows"))
        held = counts.filter(F.col("rows") > rows_per_task)
        small = rows.join(counts.filter(F.col("rows") <= rows_per_task), group, "left_semi").select(*columns)
        ready = small if ready is None else ready.unionByName(small)
        if not held.limit(1).count():
            return named, joins, ready
        unit = F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(1 << 30)) / float(1 << 30)
        hot = rows.join(held, group)
        pivots = hot.filter(unit * F.col("rows") < _PIVOTS).groupBy(*group).agg(F.collect_list("pos").alias("pivots"))
        hot = hot.join(pivots, group, "left")

        def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(pa.chunked_array([batch.column("pos")]), dims)
                pivot = batch.column("pivots")
                first, others = np.full(len(x), -1), [[] for _ in range(len(x))]
                seen: set[tuple[int, ...]] = set()
                keys_ = list(zip(*(batch.column(k).to_pylist() for k in group), strict=True))
                for key in dict.fromkeys(keys_):
                    mine = np.array([i for i, k in enumerate(keys_) if k == key])
                    own = pivot[int(mine[0])].as_py()
                    if not own:
                        continue
                    hit = within(x[mine], np.array(own, np.float64), reach)
                    first[mine] = np.where(hit.any(1), hit.argmax(1), -1)
                    # What pivots have a row in common: once a batch and set of pivots.
                    for i, h in zip(mine, hit, strict=True):
                        t = tuple(np.flatnonzero(h))
                        if len(t) > 1 and (key, t) not in seen:
                            seen.add((key, t))
                            others[i] = list(t)
                out = batch.select([*columns, "rows"])
                yield out.append_column("first", pa.array(first, pa.int32())).append_column("shared", pa.array(others, pa.list_(pa.int32())))

        shape = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
        near = written(hot.mapInArrow(touch, f"{shape}, rows long, first int, shared array<int>"))
        sizes = near.filter("first >= 0").groupBy(*group, "first").agg(F.count("*").alias("n"), F.min("id").alias("low"))
        links = near.filter("size(shared) > 1").groupBy(*group).agg(F.collect_set("shared").alias("sets"))
        sizes = sizes.groupBy(*group).agg(F.collect_list(F.struct("first", "n", "low")).alias("sizes")).join(links, group, "left")

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                main, label = [], []
                for own, sets in zip(batch.column("sizes").to_pylist(), batch.column("sets").to_pylist(), strict=True):
                    up = np.arange(4 * _PIVOTS * 8)
                    for t in sets or ():
                        up = linked(np.full(len(t), t[0]), np.array(t), up)
                    total: dict[int, int] = {}
                    for v in own:
                        total[up[v["first"]]] = total.get(up[v["first"]], 0) + v["n"]
                    best = max(total, key=lambda k: (total[k], -k))
                    main.append([v["first"] for v in own if up[v["first"]] == best])
                    label.append(min(v["low"] for v in own if up[v["first"]] == best))
                yield batch.select(group).append_column("main", pa.array(main, pa.list_(pa.int32()))).append_column("label", pa.array(label, pa.int64()))

        core = cut(sizes.mapInArrow(largest, f"{typed}, main array<int>, label long"))
        marked = near.join(core, group, "left").withColumn("in", F.coalesce(F.array_contains("main", F.col("first")), F.lit(False)))
        named.append(marked.filter("in").select(*keys, "id", "label", "several"))
        # They may get a name from that group besides the one from among themselves.
        rest = written(marked.filter("not in").withColumn("several", F.lit(True)).select(*columns, "rows", "label"))
        # Those left over against the group, in blocks of it.
        blocks = F.ceil(F.col("rows") / rows_per_task).cast("int")
        left = rest.filter("label is not null").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        right = marked.filter("in").select(*group, "pos", F.pmod(F.xxhash64("id", F.lit(seed)), blocks).cast("int").alias("block"))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            if len(a) and len(b):
                a = a.filter(pa.array(any_within(_matrix(b["pos"], dims), _matrix(a["pos"], dims), reach) >= 0))
            else:
                a = a.slice(0, 0)
            return a.select([*keys, "id", "label"])

        met = left.select(*group, "block", "id", "pos", "label").groupBy(*group, "block").cogroup(right.groupBy(*group, "block")).applyInArrow(meet, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "id long, label long"]))
        joins.append(written(met.distinct()))
        rows = rest.select(*columns)
    raise RuntimeError("dense cells were not used up")


def reach_groups(
    df: DataFrame,
    id_col: str,
    pos_col: str,
    dims: int,
    reach: float,
    keys: Sequence[str] = (),
    cell_width: float | None = None,
    rows_per_cell: int = 30_000,
    rows_per_task: int = 100_000,
    seed: int = 7,
) -> DataFrame:
    """``(keys.., id, label)``: ``label`` is the smallest id linked to ``id`` by steps of at most ``reach``.

    Groups are formed within equal ``keys``. Rows must have unique ids per key and ``dims`` finite
    elements in ``pos_col`` (filter first); a row linked to none is its own group, coincident rows are
    linked, an empty table gives an empty result. Other columns are ignored. The number of features
    quantised follows from the number of rows, so cells keep about ``rows_per_cell`` rows at any size;
    cells above ``rows_per_task`` rows are divided further, or grouped by pivots.
    """
    keys = list(keys)
    width = float(cell_width or 10.0 * reach)
    kind = df.schema[pos_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    df = written(df.select(*keys, F.col(id_col).cast("long").alias("id"), F.col(pos_col).cast(f"array<{kind}>").alias("pos")))
    stats = df.agg(F.count("*").alias("n"), *[F.stddev_pop(F.col("pos")[d]).alias(f"s{d}") for d in range(dims)]).first()
    spread = sorted(((stats[f"s{d}"] or 0.0, -d) for d in range(dims)), reverse=True)
    wanted = max(0, math.ceil(math.log(max(1.0, stats["n"] / rows_per_cell)) / math.log(2.5)))
    chosen = [-d for s, d in spread[:wanted] if s > width / 8]

    placed = df.withColumn("cell", F.lit(seed).cast("long")).withColumn("several", F.lit(False))
    for d in chosen:
        placed = _copied(placed, F.col("pos")[d].cast("double") / width, F.lit(width), reach)
    ready, dense = _divided(placed, keys, dims, reach, rows_per_task)
    named, joins = [], []
    if dense is not None:
        named, joins, left = _dense(dense, keys, dims, reach, rows_per_task, seed)
        ready.append(left)

    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), T.StructField("several", T.BooleanType())])

    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        label = np.empty(len(ids), np.int64)
        label[order] = ids[order][local_groups(_matrix(table["pos"], dims)[order], reach)]
        return pa.table([*(table[k] for k in keys), table["id"], pa.array(label), table["several"]], names=[*keys, "id", "label", "several"])

    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    found = every.select(*keys, "id", "pos", "cell", "several").groupBy(*keys, "cell").applyInArrow(run, schema)
    for n in named:
        found = found.unionByName(n)
    for j in joins:
        found = found.unionByName(j.withColumn("several", F.lit(True)))
    found = written(found)
    alone = found.filter("not several").select(*keys, "id", "label")
    border = found.filter("several").groupBy(*keys, "id").agg(F.collect_set("label").alias("labels")).withColumn("label", F.array_min("labels"))
    border = cut(border)
    pairs = border.filter(F.size("labels") > 1).select(*keys, F.col("label").alias("a"), F.explode("labels").alias("b")).filter("a <> b").distinct()
    least = propagate(pairs)
    out = alone.unionByName(border.select(*keys, "id", "label"))
    return out.join(least, [*keys, "label"], "left").select(*keys, "id", F.coalesce("least", "label").alias("label"))


def describe_groups(df: DataFrame, groups: DataFrame, id_col: str, pos_col: str, dims: int, cell: float, least: int = 10, typical: int = 3) -> DataFrame:
    """``(anchor_id, size, typical)`` of each group of at least ``least`` rows.

    Typical members are those in the group's densest cell (all features quantised at ``cell``), the
    smallest ids of it; among equally dense cells the one with the smallest id.
    """
    q = F.xxhash64(*[F.floor(F.col(pos_col)[d] / cell) for d in range(dims)])
    rows = df.select(F.col(id_col).alias("id"), q.alias("q")).join(groups, "id")
    dense = rows.groupBy("label", "q").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    dense = dense.groupBy("label").agg(F.sum("n").alias("size"), F.max_by("q", F.struct("n", -F.col("low"))).alias("q")).filter(F.col("size") >= least)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    top = rows.join(dense, ["label", "q"]).withColumn("r", rank).filter(F.col("r") <= typical)
    return top.groupBy(F.col("label").alias("anchor_id")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list("id")).alias("typical"))
