"""The k most similar vectors of every vector, by a forest of sorted hash strings.

Every tree gives each vector a long hash string: the vector is turned by a random rotation, shifted, and
a few of its coordinates are quantised; the bits of the quantised values, coarse bits first and taken in
turn, are the string. Strings with a longer common prefix lie in a smaller common cell. Each tree is one
sorted array of strings, cut into stretches at strings of a sample, one stretch a task.

A task descends in its stretch of the array: a run of strings with a common prefix is divided at its
next differing bit until it holds at most ``leaf`` rows, so the prefix is as long as the density there
allows; runs of equal strings go on with finer bits. Every asking row is ranked within its run. Then all
rows that are in doubt ascend together: a row whose ball (the distance of its k-th candidate) may reach
out of its run is ranked in every other run of the stretch that the ball can touch. It is settled when
no cell that the ball touches belongs to another stretch: no nearer row can then be elsewhere.

Trees come one after another. Settled rows ask no more; the others take what they have found with them
to the next tree, which cuts the space elsewhere. In the last tree rows go to every stretch that their
ball touches, and are settled by that.

Copies: of equal vectors each task keeps the k + 1 smallest ids. The others have k copies with smaller
ids, and so these as their neighbours; they are in no array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import partitions, written

_BITS = 18
_TAKEN = 7
_PAIRS = 200_000
_NONE = np.iinfo(np.int64).max


class HashTree:
    """One tree's hash: rotation, shift, ``_TAKEN`` coordinates of ``_BITS`` bits, interleaved into two words.

    Rows farther than ``scale`` from ``centre`` fall into the outermost cells, which have no outer border.
    """

    def __init__(self, dims: int, tree: int, scale: float, seed: int, centre: np.ndarray | float = 0.0):
        rng = np.random.default_rng((seed, tree))
        q, r = np.linalg.qr(rng.normal(size=(max(dims, _TAKEN), max(dims, _TAKEN))))
        self.turn = (q * np.sign(np.diag(r)))[:dims, :_TAKEN]
        self.shift = rng.uniform(0, 1, _TAKEN)
        self.scale, self.centre = scale, centre

    def quantised(self, x: np.ndarray, fine: int = 0) -> np.ndarray:
        """Coordinates in units of the last bit; with ``fine`` those bits beyond, of the part left over."""
        unit = np.clip(((x - self.centre) @ self.turn / self.scale + 1.0 + self.shift) / 3.0, 0.0, 1.0 - 1e-9)
        for _ in range(fine):
            unit = unit * (1 << _BITS)
            unit = unit - np.floor(unit)
        return unit * (1 << _BITS)

    @staticmethod
    def words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The string of each row of quantised coordinates as two non-negative words, the first the more significant."""
        q = np.clip(at, 0, (1 << _BITS) - 1).astype(np.int64)
        out = []
        half = _BITS // 2
        for lo in (half, 0):
            w = np.zeros(len(q), np.int64)
            for b in range(half - 1, -1, -1):
                for j in range(_TAKEN):
                    w = (w << 1) | ((q[:, j] >> (lo + b)) & 1)
            out.append(w)
        return out[0], out[1]

    def keys(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """String and id as bytes that sort like the array."""
        return as_keys(*self.words(self.quantised(x)), ids)

    def box(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest quantised coordinates of rows within ``radius`` of each row."""
        at, r = self.quantised(x), np.minimum(radius / self.scale / 3.0 * (1 << _BITS) + 1e-6, 1e12)[:, None]
        return tuple(np.clip(np.floor(v), 0, (1 << _BITS) - 1).astype(np.int64) for v in (at - r, at + r))


def as_keys(*words: np.ndarray) -> np.ndarray:
    """Words as bytes that sort like them; the last may be negative."""
    out = np.empty((len(words[0]), len(words)), ">u8")
    for i, w in enumerate(words):
        out[:, i] = w.astype(np.int64).view(np.uint64)
    if len(words) == 3:
        out[:, 2] ^= np.uint64(1 << 63)
    return out.view(f"S{8 * len(words)}").ravel()


def touched(low: np.ndarray, high: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the boxes ``low .. high`` and of the stretches whose cells each touches.

    ``bounds`` are the strings (without ids) at which the array is cut. All boxes descend together, one
    bit at a time; a cell that lies in one stretch, or whole in the box, is not divided further.
    """
    parts = len(bounds) + 1
    which = np.arange(len(low))
    corner = np.zeros_like(low)
    words = np.zeros((len(low), 2), np.int64)
    half = _BITS * _TAKEN // 2
    pairs = []
    for depth in range(2 * half + 1):
        rest = [max(0, half - max(0, depth - w * half)) for w in (0, 1)]
        ones = [(1 << min(half, r)) - 1 for r in rest]
        least = np.searchsorted(bounds, as_keys(words[:, 0], words[:, 1]), side="left")
        most = np.searchsorted(bounds, as_keys(words[:, 0] | ones[0], words[:, 1] | ones[1]), side="right")
        sizes = np.array([1 << (_BITS - (depth - j + _TAKEN - 1) // _TAKEN) if depth > j else 1 << _BITS for j in range(_TAKEN)])
        done = (least == most) | (depth == 2 * half) | ((corner >= low[which]) & (corner + sizes - 1 <= high[which])).all(1)
        count = (most - least)[done] + 1
        each = np.repeat(np.arange(len(count)), count)
        pairs.append(which[done][each] * parts + least[done][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count))
        go = ~done
        which, corner, words = which[go], corner[go], words[go]
        if not len(which):
            break
        j, level = depth % _TAKEN, _BITS - 1 - depth // _TAKEN
        middle = corner[:, j] + (1 << level)
        left, right = low[which, j] < middle, high[which, j] >= middle
        up, up_words = corner[right].copy(), words[right].copy()
        up[:, j] += 1 << level
        up_words[:, depth // half] |= 1 << (half - 1 - depth % half)
        which, corner, words = np.concatenate([which[left], which[right]]), np.concatenate([corner[left], up]), np.concatenate([words[left], up_words])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both // parts, both % parts


def runs(hi: np.ndarray, lo: np.ndarray, leaf: int) -> list[tuple[int, int, bool]]:
    """Division of a sorted array of strings into runs of at most ``leaf`` rows.

    Runs of equal strings may be longer and are marked.
    """
    out: list[tuple[int, int, bool]] = []
    todo = [(0, len(hi))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            if b > a:
                out.append((a, b, False))
            continue
        word = hi if hi[a] != hi[b - 1] else lo
        differ = int(word[a]) ^ int(word[b - 1])
        if not differ:
            out.append((a, b, True))
            continue
        bit = differ.bit_length() - 1
        mid = a + int(np.searchsorted(word[a:b], (int(word[b - 1]) >> bit) << bit))
        todo += [(mid, b), (a, mid)]
    return out


def nearest(x: np.ndarray, ids: np.ndarray, query: np.ndarray, own: np.ndarray, k: int, spare: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the k rows nearest to each row of ``query``, without the row whose id it has (ties: smaller id).

    Missing neighbours have id ``_NONE`` and an infinite distance. A matrix product ranks roughly; the
    best of it are measured exactly, on the given values, so that a pair has the same distance wherever it meets.
    """
    n, m = len(x), len(query)
    best, dist = np.full((m, k), _NONE, np.int64), np.full((m, k), np.inf)
    if not n or not m:
        return best, dist
    mid = x.mean(0)
    rough = x - mid
    take = k + 1 + spare
    norms = (rough * rough).sum(1)
    double = np.concatenate([-2.0 * rough.T, norms[None]])
    top = np.maximum(1.0, norms.max())
    step = max(32, _PAIRS // n)
    for lo in range(0, m, step):
        asked, me = query[lo : lo + step], own[lo : lo + step]
        whole = np.zeros(0, int)
        if take >= n:
            near = np.broadcast_to(np.arange(n), (len(asked), n))
        else:
            y = asked - mid
            d = np.concatenate([y, np.ones((len(y), 1))], 1) @ double
            cut_at = np.partition(d, take - 1, axis=1)[:, take - 1]
            within = d <= cut_at[:, None]
            near = np.empty((len(asked), take), np.int64)
            tied = within.sum(1) > take
            if tied.any():
                near[~tied] = (np.flatnonzero(within[~tied]) % n).reshape(-1, take)
                near[tied] = np.argpartition(d[tied], take - 1, axis=1)[:, :take]
            else:
                near = (np.flatnonzero(within) % n).reshape(-1, take)
        exact = ((asked[:, None, :] - x[near]) ** 2).sum(2)
        names = ids[near]
        self_ = names == me[:, None]
        exact[self_] = np.inf
        names[self_] = _NONE
        order = np.lexsort((names, exact), axis=1)[:, :k]
        w = order.shape[1]
        best[lo : lo + step, :w], dist[lo : lo + step, :w] = np.take_along_axis(names, order, 1), np.take_along_axis(exact, order, 1)
        if take < n:
            # Rows whose cut is within rounding of the k-th distance are ranked over all rows.
            size = (y * y).sum(1)
            whole = np.flatnonzero(cut_at + size - dist[lo : lo + step, -1] <= 1e-9 * (top + size))
        for i in whole:
            e = ((asked[i] - x) ** 2).sum(1)
            e[ids == me[i]] = np.inf
            o = np.lexsort((ids, e))[:k]
            best[lo + i, : len(o)], dist[lo + i, : len(o)] = np.where(np.isinf(e[o]), _NONE, ids[o]), e[o]
    return best, dist


def merged(near: np.ndarray, d2: np.ndarray, more: np.ndarray, more_d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists a row; an id that is in both counts once."""
    near, d2 = np.concatenate([near, more], 1), np.concatenate([d2, more_d2], 1)
    order = np.argsort(near, axis=1, kind="stable")
    near, d2 = np.take_along_axis(near, order, 1), np.take_along_axis(d2, order, 1)
    again = near[:, 1:] == near[:, :-1]
    near[:, 1:][again], d2[:, 1:][again] = _NONE, np.inf
    order = np.lexsort((near, d2), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1), np.take_along_axis(d2, order, 1)


def equal_rows(x: np.ndarray) -> np.ndarray:
    """For each row the number of the first row equal to it."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    factor = np.random.default_rng(1).integers(1, 1 << 62, words.shape[1], dtype=np.uint64) | np.uint64(1)
    mixed = words @ factor
    order = np.argsort(mixed, kind="stable")
    first = np.arange(len(x))
    same = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
    # Among equal hashes rows are compared with the first of the hash; others of it (a collision) one by one.
    for i in same:
        a, b = order[i], order[i + 1]
        if np.array_equal(x[first[a]], x[b]):
            first[b] = first[a]
    return first


class Stretch:
    """A task's part of one tree's sorted array, its runs and their boxes."""

    def __init__(self, tree: HashTree, x: np.ndarray, ids: np.ndarray, leaf: int):
        self.tree, self.leaf = tree, leaf
        hi, lo = tree.words(tree.quantised(x))
        self.order = np.lexsort((ids, lo, hi))
        hi, lo = hi[self.order], lo[self.order]
        self.spans: list[tuple[int, int]] = []
        for a, b, equal in runs(hi, lo, leaf):
            self.spans += self._finer(x, a, b, 1) if equal else [(a, b)]
        self.x, self.ids = x[self.order], ids[self.order]
        # Boxes in single precision, wider than the rows by more than its rounding.
        slack = 1e-6 * (1.0 + float(np.abs(self.x).max()))
        self.low = np.array([self.x[a:b].min(0) - slack for a, b in self.spans], np.float32).T.copy()
        self.high = np.array([self.x[a:b].max(0) + slack for a, b in self.spans], np.float32).T.copy()
        first = [a for a, _ in self.spans]
        self.first = as_keys(hi[first], lo[first])

    def _finer(self, x: np.ndarray, a: int, b: int, fine: int) -> list[tuple[int, int]]:
        """Runs of rows with equal strings by the bits that come after; rows equal to the last bit of a float stay one run."""
        mine = self.order[a:b]
        hi, lo = self.tree.words(self.tree.quantised(x[mine], fine))
        by = np.lexsort((mine, lo, hi))
        self.order[a:b] = mine[by]
        out: list[tuple[int, int]] = []
        for c, d, equal in runs(hi[by], lo[by], self.leaf):
            out += self._finer(x, a + c, a + d, fine + 1) if equal and fine < 2 else [(a + c, a + d)]
        return out

    def _gaps(self, y: np.ndarray, within: np.ndarray, first: int = 8) -> np.ndarray:
        """Squared distance, or somewhat less, of each row to each run's box; infinite where it is more than ``within``."""
        y = y.astype(np.float32)

        def part(j: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.maximum(low - at, at - high)
            np.maximum(out, 0, out=out)
            out *= out
            return out

        gap = np.zeros((len(y), len(self.spans)), np.float32)
        for j in range(min(first, y.shape[1])):
            gap += part(j, y[:, j][:, None], self.low[j], self.high[j])
        # The other features only of the pairs that are still close enough.
        row, run = np.nonzero(gap * np.float32(1 - 1e-5) <= within[:, None])
        left = gap[row, run]
        for j in range(first, y.shape[1]):
            left += part(j, y[row, j], self.low[j][run], self.high[j][run])
        left *= np.float32(1 - 1e-5)
        gap[:] = np.inf
        near = left <= within[row]
        gap[row[near], run[near]] = left[near]
        return gap

    def search(self, y: np.ndarray, own: np.ndarray, near: np.ndarray, d2: np.ndarray, k: int, radius: float, bounds: np.ndarray, part: int, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists of the asking rows (``y`` with ids ``own``) after this stretch, number ``part``, and whether each is settled.

        ``near`` and ``d2`` are what other stretches have found; ``fresh`` that there is nothing yet.
        """
        strings = as_keys(*self.tree.words(self.tree.quantised(y)))
        run = np.maximum(0, np.searchsorted(self.first, strings, side="right") - 1)
        order = np.argsort(run, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(run[order])) + 1, len(run))
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            mine = order[lo:hi]
            if len(mine):
                a, b = self.spans[run[mine[0]]]
                got = nearest(self.x[a:b], self.ids[a:b], y[mine], own[mine], k)
                near[mine], d2[mine] = got if fresh else merged(near[mine], d2[mine], *got, k)
        # Settled at once: all cells that the ball touches are within the run. The others ascend together.
        low, high = self.tree.box(y, np.minimum(np.sqrt(d2[:, -1]), radius))
        least, most = as_keys(*self.tree.words(low)), as_keys(*self.tree.words(high))
        end = bounds[part : part + 1] if part < len(bounds) else np.array([b"\xff" * 16])
        after = np.append(self.first[1:], end)[run]
        doubt = np.flatnonzero(~((least > self.first[run]) & (most < after)))
        for lo in range(0, len(doubt), 4096):
            rows = doubt[lo : lo + 4096]
            gap = self._gaps(y[rows], np.minimum(d2[rows, -1], radius * radius))
            gap[np.arange(len(rows)), run[rows]] = np.inf
            for r in np.flatnonzero((gap < np.inf).any(0)):
                a, b = self.spans[r]
                q = rows[gap[:, r] <= np.minimum(d2[rows, -1], radius * radius)]
                if len(q):
                    near[q], d2[q] = merged(near[q], d2[q], *nearest(self.x[a:b], self.ids[a:b], y[q], own[q], k), k)
        settled = np.ones(len(y), bool)
        if len(bounds) and len(doubt):
            low, high = self.tree.box(y[doubt], np.minimum(np.sqrt(d2[doubt, -1]), radius))
            who, to = touched(low, high, bounds)
            settled[doubt[who[to != part]]] = False
        return near, d2, settled


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lists(values: np.ndarray, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of ``values`` as lists where ``valid``, else null."""
    ends = np.append(0, np.cumsum(valid)).astype(np.int32) * values.shape[1]
    flat = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~valid, False)), pa.array(values[valid].ravel(), kind))
    return flat


def _taken(df: DataFrame, dims: int, k: int) -> DataFrame:
    """``df(id, pos)`` with, of equal vectors in a task, the k + 1 smallest ids; the others without ``pos`` but with the vector's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= 200_000:
                yield from keep(held)
                held, rows = [], 0
        if held:
            yield from keep(held)

    def keep(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(t["pos"].combine_chunks(), dims)[order] + t["pos"].type.value_type.to_pandas_dtype()(0)
        first = equal_rows(x)
        by = np.argsort(first, kind="stable")
        place = np.empty(len(ids), np.int64)
        new = np.append(True, first[by][1:] != first[by][:-1])
        place[by] = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        more = place > k
        hashes = np.zeros((len(ids), 2), np.int64)
        if more.any():
            hashes[more] = _hashed(x[more])
        out = [pa.array(ids), _lists(x, ~more, t["pos"].type.value_type), pa.array(hashes[:, 0], mask=~more), pa.array(hashes[:, 1], mask=~more)]
        yield from pa.Table.from_arrays(out, ["id", "pos", "h1", "h2"]).to_batches(max_chunksize=20_000)

    kind = df.schema["pos"].dataType.simpleString()
    return df.mapInArrow(run, f"id long, pos {kind}, h1 long, h2 long")


def _hashed(x: np.ndarray) -> np.ndarray:
    """Two hash words of each row."""
    words = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    factor = np.random.default_rng(2).integers(1, 1 << 62, (words.shape[1], 2), dtype=np.uint64) | np.uint64(1)
    h = words @ factor
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _bare(bounds: np.ndarray) -> np.ndarray:
    """Bounds without their ids."""
    return np.array([b.ljust(24, b"\0")[:16] for b in bounds.tolist()], "S16")


def _tree_pass(rows: DataFrame, asking: DataFrame | None, tree: HashTree, bounds: np.ndarray, dims: int, k: int, leaf: int, radius: float, last: bool) -> DataFrame:
    """``(id, pos, near, d2, ask)``: the asking rows after one tree; those now settled have ``ask`` false and no ``pos``.

    ``rows(id, pos)`` is what is searched; without ``asking(id, pos, near, d2)`` every row asks. In the
    ``last`` tree asking rows go to all stretches that their ball touches, and come back from each.
    """
    kind = rows.schema["pos"].dataType.simpleString()
    strings, opening = _bare(bounds), asking is None

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims).astype(np.float64)
                part = np.searchsorted(bounds, tree.keys(x, batch.column(0).to_numpy()), side="right").astype(np.int32)
                yield batch.append_column("part", pa.array(part))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, d2 = _matrix(batch.column(1), dims).astype(np.float64), _matrix(batch.column(3), k)
                who, to = touched(*tree.box(x, np.minimum(np.sqrt(d2[:, -1]), radius)), strings)
                yield batch.take(pa.array(who)).append_column("part", pa.array(to.astype(np.int32)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        part = t["part"].to_numpy()
        for p in np.unique(part):
            yield from one(t.filter(pa.array(part == p)).combine_chunks(), int(p))

    def one(t: pa.Table, p: int) -> Iterator[pa.RecordBatch]:
        asks = t
        if not opening:
            mine = pa.compute.greater(pa.compute.list_value_length(t["near"]), 0)
            t, asks = t.filter(pa.compute.invert(mine)), t.filter(mine).combine_chunks()
        given = _matrix(asks["pos"].combine_chunks(), dims)
        own, n = asks["id"].to_numpy(), len(given)
        near, d2 = np.full((n, k), _NONE, np.int64), np.full((n, k), np.inf)
        if not opening:
            near, d2 = (_matrix(asks[c].combine_chunks(), k).copy() for c in ("near", "d2"))
        settled = np.zeros(n, bool)
        if n and len(t):
            s = Stretch(tree, _matrix(t["pos"].combine_chunks(), dims).astype(np.float64), t["id"].to_numpy(), leaf)
            near, d2, settled = s.search(given.astype(np.float64), own, near, d2, k, radius, strings, p, opening)
        whole, still = np.ones(n, bool), np.zeros(n, bool) if last else ~settled
        out = [asks["id"], _lists(given, still, asks["pos"].type.value_type), _lists(near, whole, pa.int64()), _lists(d2, whole, pa.float64()), pa.array(still)]
        yield from pa.Table.from_arrays(out, ["id", "pos", "near", "d2", "ask"]).to_batches(max_chunksize=20_000)

    placed = rows.mapInArrow(route, f"id long, pos {kind}, part int")
    if asking is not None:
        to = asking.mapInArrow(spread if last else route, f"id long, pos {kind}, near array<long>, d2 array<double>, part int")
        # Empty lists, not nulls: a batch of null lists takes the square of its rows to convert.
        none = [F.array().cast(f"array<{v}>").alias(c) for c, v in (("near", "long"), ("d2", "double"))]
        placed = placed.select("id", "pos", *none, "part").unionByName(to)
    return placed.repartitionById(len(bounds) + 1, "part").mapInArrow(work, f"id long, pos {kind}, near array<long>, d2 array<double>, ask boolean")


def _best(found: DataFrame, k: int) -> DataFrame:
    """One list per id from the lists of several stretches."""
    pair = F.explode(F.arrays_zip("d2", "near")).alias("n")
    best = found.select("id", pair).filter(F.col("n.near") < _NONE).distinct()
    best = best.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("n"))
    return best.select("id", F.col("n.near").alias("near"), F.col("n.d2").alias("d2"))


def _copies(base: DataFrame, dims: int, k: int) -> DataFrame:
    """``(id, near, d2)`` of the rows left out of the arrays: the k smallest ids of their vector."""
    extra = base.filter("pos is null").select("id", "h1", "h2")
    kept = base.filter("pos is not null").select("id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hashed(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], names=["id", "h1", "h2"])

    held = kept.mapInArrow(run, "id long, h1 long, h2 long").join(extra.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    best = held.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("near"))
    return extra.join(best, ["h1", "h2"]).select("id", "near", F.transform("near", lambda _: F.lit(0.0)).alias("d2"))


def knn_forest(
    df: DataFrame, id_col: str, pos_col: str, dims: int, k: int = 5, trees: int = 2, leaf: int = 1536, radius: float | None = None, seed: int = 7, rows_per_task: int = 50_000, sample: int = 20_000
) -> DataFrame:
    """``(node, rank, neighbor, dist)``: the k nearest other rows of every row, rank 1 the nearest.

    Exact: a row is settled by its stretch of some tree, or by all stretches of the last tree that its
    ball touches. With ``radius`` only neighbours within it need be right: rows are settled as soon as
    no nearer one is that close. Without, rows far from all others reach many stretches of the last tree.
    Equal distances rank by the smaller id. Ids must be unique and ``pos_col`` must have ``dims`` finite
    elements (filter first). Rows without any other row give none; an empty table gives an empty result.
    Other columns are ignored.

    Every row is searched for and all but further copies are indexed; only the scale of the hash and the
    borders of the stretches are fitted on ``sample`` rows (32 a stretch where that is more), which go to the driver.
    """
    kind = df.schema[pos_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    base = written(_taken(df.select(F.col(id_col).cast("long").alias("id"), F.col(pos_col).cast(f"array<{kind}>").alias("pos")), dims, k))
    n, extras = base.agg(F.count("pos"), F.count("h1")).first()
    rows = base.filter("pos is not null").select("id", "pos")
    parts = max(1, -(-n // rows_per_task), min(partitions(df.sparkSession), n // (8 * leaf)))
    wanted = max(sample, 32 * parts)
    share = max(1, n // wanted)
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(share)) == 0).limit(2 * wanted).toArrow()
    reach = float("inf") if radius is None else float(radius)
    ids, x = drawn["id"].to_numpy(), _matrix(drawn["pos"].combine_chunks(), dims).astype(np.float64) if len(drawn) else np.zeros((0, dims))
    ranges = np.percentile(x, [1, 50, 99], axis=0) if len(x) else np.zeros((3, dims))
    centre, scale = ranges[1], float(np.sqrt((np.maximum(ranges[2] - ranges[1], ranges[1] - ranges[0]) ** 2).sum())) or 1.0

    stages: list[DataFrame] = []
    trees = max(2, trees)
    for t in range(trees):
        tree = HashTree(dims, t, scale, seed, centre)
        keys = np.sort(tree.keys(x, ids))
        bounds = np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if parts > 1 and len(keys) else np.zeros(0, "S24")
        asking = stages[-1].filter("ask").drop("ask") if stages else None
        stages.append(written(_tree_pass(rows, asking, tree, bounds, dims, k, leaf, reach, 0 < t == trees - 1)))
        if not stages[-1].filter("ask").limit(1).count():
            break
    found = [s.filter("not ask") for s in stages]
    if 1 < len(found) == trees:
        found[-1] = _best(found[-1], k)
    if extras:
        found.append(_copies(base, dims, k))
    out = found[0].select("id", "near", "d2")
    for f in found[1:]:
        out = out.unionByName(f.select("id", "near", "d2"))
    pair = F.posexplode(F.arrays_zip("near", "d2")).alias("i", "n")
    out = out.select(F.col("id").alias("node"), pair).filter(F.col("n.near") < _NONE)
    return out.select("node", (F.col("i") + 1).alias("rank"), F.col("n.near").alias("neighbor"), F.sqrt("n.d2").alias("dist"))
