"""Cutting oversized point sets into pieces at natural boundaries (content-defined chunking).

A set's natural boundaries are those between its bodies: largest sets of points linked by steps of at
most ``reach``. Its points are put in a sequence body by body (bodies by their smallest node, nodes in
order). A rolling hash over the quantised positions marks landmarks in the sequence; a cut is sought
from the first landmark that gives a piece its minimum size and snaps to the nearest boundary between
bodies that keeps the piece within its limits, else to a boundary before the minimum, else (a body
larger than a piece) it stays at the landmark, else at the maximum. Cuts depend on content near them
only, so an edit alters the pieces around it and the sequence falls back into step after it.

Whole sets are worked on in one task, many at a time, up to ``rows_per_set`` delivered rows. Larger
sets are grouped by the distributed grid clustering, put in sequence by a range partitioning and
numbered; only the places of their landmarks and bodies' borders meet in one task, which finds the same
cuts as for a whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.common import current_rows, cut, finite, partitions
from stipple.llm.reach import linked, reach_groups

OUT = "cloud_id long, piece long, seq int, node_id long, body long, body_size long, shared boolean"
# Half of the cells that are near enough to a cell, nearest first, when a cell's diagonal is the reach.
_TWO = (-2, -1, 0, 1, 2)
_NEAR = sorted(((dx, dy, dz) for dx in _TWO for dy in _TWO for dz in _TWO if (dx, dy, dz) > (0, 0, 0)), key=lambda v: sum(u * u for u in v))
_WINDOW = 16
_EVERY = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _cell_keys(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    h = _mix(group.astype(np.uint64))
    for d in range(3):
        h = _mix(h * np.uint64(3) + cell[:, d].astype(np.int64).view(np.uint64))
    return h


def bodies(group: np.ndarray, x: np.ndarray, reach: np.ndarray, budget: int = 4_000_000) -> np.ndarray:
    """Smallest row index linked to each row by steps of at most its group's ``reach`` within its group.

    All groups at once: rows are hashed into cells whose diagonal is the reach, so the rows of a cell are
    one body at once; rows of different bodies in cells near each other are compared, ``budget`` pairs at
    a time. Exact; rows of cells with the same hash are told apart.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    cell = np.floor(x / (reach[:, None] * (0.999999 / np.sqrt(3.0))))
    order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0], group))
    g, c = group[order], cell[order]
    starts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]).any(1)))
    sizes = np.diff(np.append(starts, n))
    g, c = g[starts], c[starts]
    label = np.arange(n)
    label[order] = np.repeat(np.minimum.reduceat(order, starts), sizes)
    keys = _cell_keys(g, c)
    by = np.argsort(keys, kind="stable")
    for off in _NEAR:
        want = _cell_keys(g, c + np.array(off))
        at = by[np.minimum(np.searchsorted(keys, want, sorter=by), len(keys) - 1)]
        a_cell = np.flatnonzero((keys[at] == want) & (g[at] == g) & (c[at] == c + np.array(off)).all(1))
        b_cell = at[a_cell]
        # Pairs of cells that are not of one body yet; a pair may take several turns, from where it was left.
        done = np.zeros(len(a_cell), np.int64)
        while True:
            apart = label[order[starts[a_cell]]] != label[order[starts[b_cell]]]
            left = sizes[a_cell] * sizes[b_cell] - done
            go = np.flatnonzero(apart & (left > 0))
            if not len(go):
                break
            a_cell, b_cell, done, left = a_cell[go], b_cell[go], done[go], left[go]
            take = np.minimum(left, np.maximum(0, budget - (np.cumsum(left) - left)))
            pair = np.repeat(np.arange(len(take)), take)
            k = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + done[pair]
            nb = sizes[b_cell][pair]
            a, b = order[starts[a_cell][pair] + k // nb], order[starts[b_cell][pair] + k % nb]
            near = ((x[a] - x[b]) ** 2).sum(1) <= reach[a] ** 2
            label = linked(a[near], b[near], label)
            done = done + take
    return label


def landmarks(group_start: np.ndarray, x: np.ndarray, grain: np.ndarray, every: int) -> np.ndarray:
    """Whether the rolling hash over the last rows' quantised positions marks a row, one in ``every``."""
    q = np.floor(x / grain[:, None])
    total = np.append(np.uint64(0), np.cumsum(_cell_keys(np.zeros(len(x)), q), dtype=np.uint64))
    i = np.arange(len(x))
    rolled = total[i + 1] - total[np.maximum(group_start, i + 1 - _WINDOW)]
    return _mix(rolled) % np.uint64(every) == 0


def cuts(body: np.ndarray, marks: np.ndarray, capacity: int, overlap: int) -> list[int]:
    """Ends of the pieces of one sequence; a piece also holds the ``overlap`` rows before it."""
    return _cuts(len(body), np.append(np.flatnonzero(body[1:] != body[:-1]) + 1, len(body)), np.flatnonzero(marks) + 1, capacity, overlap)


def _cuts(n: int, edge: np.ndarray, mark: np.ndarray, capacity: int, overlap: int) -> list[int]:
    """The same from the ends of the bodies and the places after landmarks."""
    overlap = min(overlap, capacity - 1)
    out, s = [], 0
    while True:
        most = s + capacity - (overlap if s else 0)
        if n <= most:
            out.append(n)
            return out
        least = s + max(1, (most - s) // 2)
        m = mark[np.searchsorted(mark, least) : np.searchsorted(mark, most, side="right")]
        aim = int(m[0]) if len(m) else most
        e = edge[np.searchsorted(edge, least) : np.searchsorted(edge, most, side="right")]
        if len(e):
            c = int(e[np.argmin(np.abs(e - aim))])
        else:
            e = edge[np.searchsorted(edge, s, side="right") : np.searchsorted(edge, least)]
            c = int(e[-1]) if len(e) else aim
        out.append(c)
        s = c


def _pieces(cloud: np.ndarray, node: np.ndarray, body: np.ndarray, size: np.ndarray, x: np.ndarray, capacity: np.ndarray, overlap: np.ndarray, reach: np.ndarray) -> pa.Table:
    """Piece rows of sequences given one after another."""
    n = len(cloud)
    starts = np.flatnonzero(np.append(True, cloud[1:] != cloud[:-1]))[: n or 0]
    ends = np.append(starts[1:], n)[: len(starts)]
    marks = landmarks(np.repeat(starts, ends - starts), x, reach / 4.0, _EVERY)
    index, piece, seq, shared = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        over, room = int(overlap[a]), int(capacity[a])
        s = a
        for p, c in enumerate(cuts(body[a:b], marks[a:b], room, over)):
            c += a
            head = max(a, s - min(over, room - 1))
            index.append(np.arange(head, c))
            piece.append(np.full(c - head, p))
            seq.append(np.arange(c - head))
            shared.append(np.arange(head, c) < s)
            s = c
    if not index:
        return pa.table({"cloud_id": pa.array([], pa.int64()), "piece": pa.array([], pa.int64()), "seq": pa.array([], pa.int32()), "node_id": pa.array([], pa.int64()), "body": pa.array([], pa.int64()), "body_size": pa.array([], pa.int64()), "shared": pa.array([], pa.bool_())})
    i = np.concatenate(index)
    return pa.table({"cloud_id": cloud[i], "piece": np.concatenate(piece), "seq": np.concatenate(seq).astype(np.int32), "node_id": node[i], "body": body[i], "body_size": size[i], "shared": np.concatenate(shared)})


def _positions(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Triples of an array column and whether each row has exactly three finite values."""
    n = len(col)
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ok = sizes == 3
    x = np.full((n, 3), np.nan)
    at = np.append(0, np.cumsum(sizes))[:-1][ok]
    x[ok] = values[at[:, None] + np.arange(3)]
    return x, np.isfinite(x).all(1)


def _split_sets(cols: list[np.ndarray], x: np.ndarray, usable: np.ndarray) -> pa.Table:
    """Pieces of whole sets from delivered rows: current rows, then usable ones, then sets above capacity."""
    cloud, node, at, capacity, overlap, reach = cols
    order = np.lexsort((usable, at, node, cloud))
    c, m = cloud[order], node[order]
    last = np.append((c[1:] != c[:-1]) | (m[1:] != m[:-1]), True)[: len(c)]
    order = order[last]
    # A later row at the same instant may lack the value: a usable one sorts last among equals.
    order = order[usable[order]]
    c = cloud[order]
    _, inverse, counts = np.unique(c, return_inverse=True, return_counts=True)
    order = order[counts[inverse] > capacity[order]]
    if not len(order):
        return _pieces(*(np.zeros(0, np.int64),) * 4, np.zeros((0, 3)), *(np.zeros(0, np.int64),) * 3)
    cloud, node, capacity, overlap, reach, x = (v[order] for v in (cloud, node, capacity, overlap, reach, x))
    label = bodies(cloud, x, reach)
    size = np.bincount(label, minlength=len(label))[label]
    seq = np.argsort(label, kind="stable")
    return _pieces(cloud[seq], node[seq], node[label[seq]], size[seq], x[seq], capacity[seq], overlap[seq], reach[seq])


def split_oversized(points: DataFrame, limits: DataFrame, rows_per_set: int = 200_000, rows_per_task: int = 200_000) -> DataFrame:
    """Pieces of every set with more usable points than its capacity: one row per point of a piece.

    ``points(cloud_id, node_id, pos, received_at)``: the row with the latest ``received_at`` of a key is
    current; a point is usable when its current ``pos`` has exactly three finite values. Null keys are
    dropped. ``limits(cloud_id, capacity, overlap, reach)``, one row per set: sets without one, or with a
    null capacity or reach, are left alone. Returns ``(cloud_id, piece, seq, node_id, body, body_size,
    shared)``: pieces numbered along the sequence, ``body`` the body's smallest node, ``shared`` for the
    ``overlap`` points repeated from the piece before. No piece exceeds the capacity, overlap included.
    Coincident points are separate points of one body. Empty tables give an empty result.
    """
    spark = points.sparkSession
    points = points.select("cloud_id", "node_id", "pos", "received_at").filter("cloud_id is not null and node_id is not null")
    limits = limits.select("cloud_id", F.col("capacity").cast("long"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"), F.col("reach").cast("double"))
    limits = limits.filter("capacity > 0 and reach > 0")
    delivered = points.groupBy("cloud_id").count()
    giant = cut(delivered.filter(F.col("count") > rows_per_set).select("cloud_id"))
    some_giant = bool(giant.limit(1).count())
    small = points.join(giant, "cloud_id", "left_anti") if some_giant else points
    tasks = partitions(spark)

    sets = small.repartition(tasks, "cloud_id").join(limits.repartition(tasks, "cloud_id").hint("merge"), "cloud_id")
    sets = sets.sortWithinPartitions("cloud_id").select("cloud_id", "node_id", "pos", "received_at", "capacity", "overlap", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            x, usable = _positions(t["pos"].combine_chunks())
            when = t["received_at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min)
            cols = [t["cloud_id"], t["node_id"], when, t["capacity"], t["overlap"], t["reach"]]
            yield from _split_sets([c.to_numpy() for c in cols], x, usable).to_batches(max_chunksize=100_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            sets = batch.column(0).to_numpy()
            if rows >= rows_per_task and (sets[0] != sets[-1] or batch.num_rows == 1):
                end = int(np.searchsorted(sets, sets[-1]))
                yield from work([*held[:-1], batch.slice(0, end)])
                held, rows = [batch.slice(end)], batch.num_rows - end
        if held:
            yield from work(held)

    out = sets.mapInArrow(run, OUT)
    return out.unionByName(_split_giant(points.join(giant, "cloud_id", "left_semi"), limits, rows_per_task)) if some_giant else out


def _split_giant(points: DataFrame, limits: DataFrame, rows_per_task: int) -> DataFrame:
    """The same for sets that no task should hold."""
    now = current_rows(points, ["cloud_id", "node_id"], ["pos"]).filter(finite(F.col("pos"), 3))
    counts = now.groupBy("cloud_id").count().join(limits, "cloud_id").filter(F.col("count") > F.col("capacity"))
    now = cut(now.join(counts, "cloud_id"))
    total = now.count()
    # Positions in units of the reach, so that sets of any reach are grouped together.
    scaled = now.withColumn("pos", F.transform(F.col("pos").cast("array<double>"), lambda v: v / F.col("reach")))
    named = reach_groups(scaled, "node_id", "pos", 3, 1.0, keys=["cloud_id"], cell_width=8.0)
    sizes = named.groupBy("cloud_id", "label").agg(F.count("*").alias("size"))
    rows = named.join(sizes, ["cloud_id", "label"]).join(now.withColumnRenamed("node_id", "id").drop("count"), ["cloud_id", "id"])
    rows = rows.repartitionByRange(max(1, -(-total // rows_per_task)), "cloud_id", "label", "id").sortWithinPartitions("cloud_id", "label", "id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.append_column("part", pa.array(np.full(b.num_rows, part, np.int64))).append_column("i", pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = cut(rows.mapInArrow(number, f"{kinds}, part long, i long"))
    # Each row's place g in its set: the rows of the set in earlier parts, and those before it in its own.
    spans = placed.groupBy("cloud_id", "part").agg(F.min("i").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("cloud_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = cut(spans.withColumn("start", before))
    placed = cut(placed.join(F.broadcast(spans.drop("rows")), ["cloud_id", "part"]).withColumn("g", F.col("start") + F.col("i") - F.col("first")).drop("i", "first", "start"))

    # A part also sees the window before it.
    later = spans.select(F.col("cloud_id").alias("c"), F.col("part").alias("into"), "start")
    lead = placed.join(F.broadcast(later), (F.col("cloud_id") == F.col("c")) & (F.col("g") < F.col("start")) & (F.col("g") >= F.col("start") - _WINDOW))
    lead = lead.select("cloud_id", F.col("into").alias("part"), "g", "label", "pos", "reach", "capacity", "overlap", F.lit(True).alias("lead"))
    seen = placed.select("cloud_id", "part", "g", "label", "pos", "reach", "capacity", "overlap", F.lit(False).alias("lead")).unionByName(lead)

    def places(t: pa.Table) -> pa.Table:
        t = t.sort_by("g")
        x, _ = _positions(t["pos"].combine_chunks())
        g, label, led = t["g"].to_numpy(), t["label"].to_numpy(), t["lead"].to_numpy()
        mark = landmarks(np.zeros(len(g), np.int64), x, t["reach"].to_numpy() / 4.0, _EVERY)
        edge = np.append(False, label[1:] != label[:-1])
        mark, edge = g[mark & ~led] + 1, g[edge & ~led]
        n = len(mark) + len(edge)
        return pa.table({"cloud_id": pa.array(np.full(n, t["cloud_id"][0].as_py())), "at": np.concatenate([mark, edge]), "mark": np.arange(n) < len(mark)})

    def found(t: pa.Table) -> pa.Table:
        n, room, over = (t[c].drop_null()[0].as_py() for c in ("n", "capacity", "overlap"))
        at, mark = (t[c].drop_null().to_numpy() for c in ("at", "mark"))
        ends = np.array(_cuts(n, np.append(np.sort(at[~mark]), n), np.sort(at[mark]), room, over), np.int64)
        begins = np.append(0, ends[:-1])
        heads = np.maximum(0, begins - min(over, room - 1))
        return pa.table({"cloud_id": pa.array(np.full(len(ends), t["cloud_id"][0].as_py())), "piece": np.arange(len(ends)), "head": heads, "begin": begins, "end": ends})

    sparse = seen.groupBy("cloud_id", "part").applyInArrow(places, "cloud_id long, at long, mark boolean")
    whole = counts.select("cloud_id", F.col("count").alias("n"), "capacity", "overlap")
    known = sparse.unionByName(whole, allowMissingColumns=True).groupBy("cloud_id").applyInArrow(found, "cloud_id long, piece long, head long, begin long, end long")
    # A piece is no longer than the capacity, so it lies in two stretches of that length at most.
    known = known.join(whole.select("cloud_id", "capacity"), "cloud_id").withColumn("b", F.explode(F.sequence(F.floor(F.col("head") / F.col("capacity")), F.floor((F.col("end") - 1) / F.col("capacity"))))).drop("capacity")
    out = placed.withColumn("b", F.floor(F.col("g") / F.col("capacity"))).join(known, ["cloud_id", "b"]).filter("g >= head and g < end")
    return out.select("cloud_id", "piece", (F.col("g") - F.col("head")).cast("int").alias("seq"), F.col("id").alias("node_id"), F.col("label").alias("body"), F.col("size").alias("body_size"), (F.col("g") < F.col("begin")).alias("shared"))
