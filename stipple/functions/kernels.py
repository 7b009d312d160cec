"""Numeric kernels for Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(col: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, dims if dims else (len(values) // n if n else 0))


def top_k(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, spare: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the k points nearest to each query, nearest first, ties to the smaller id.

    ``ids`` must ascend. A matrix product ranks roughly; the best are measured directly, and rows whose
    cut is too close to call are measured in full. Fewer than k points give fewer columns.
    """
    n, m = len(points), len(queries)
    k = min(k, n)
    if not n or not m:
        return np.zeros((m, 0), np.int64), np.zeros((m, 0))
    mid = points.mean(0)
    p, q = points - mid, queries - mid
    take = min(n, k + spare)
    if take == n:
        near = np.broadcast_to(np.arange(n), (m, n))
        close = np.zeros(0, int)
    else:
        d = (p * p).sum(1)[None] - 2.0 * (q @ p.T)
        near = np.sort(np.argpartition(d, take - 1, axis=1)[:, :take], axis=1)
        got = np.sort(np.take_along_axis(d, near, 1), axis=1)
        slack = 1e-9 * max(1.0, float((p * p).sum(1).max()), float((q * q).sum(1).max()))
        close = np.flatnonzero(got[:, -1] - got[:, k - 1] <= slack)
    exact = np.zeros(near.shape)
    for j in range(points.shape[1]):
        exact += (queries[:, j][:, None] - points[:, j][near]) ** 2
    order = np.lexsort((near, exact), axis=1)[:, :k]
    best, dist = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
    for i in close:
        e = np.zeros(n)
        for j in range(points.shape[1]):
            e += (queries[i, j] - points[:, j]) ** 2
        o = np.argsort(e, kind="stable")[:k]
        best[i], dist[i] = o, e[o]
    return ids[best], dist


def boxes(points: np.ndarray, leaf: int = 96) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the points and its division into runs of at most about ``leaf`` that lie close together.

    Halves at the median of the feature in which a run extends farthest; points that coincide stay one run.
    """
    order = np.arange(len(points))
    out: list[tuple[int, int]] = []
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        part = points[order[a:b]]
        extent = np.ptp(part, axis=0) if b - a > leaf else np.zeros(1)
        if b - a <= leaf or not extent.max() > 0:
            if b > a:
                out.append((a, b))
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, int(extent.argmax())], mid)]
        todo += [(a + mid, b), (a, a + mid)]
    return order, out


def near_k(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``top_k``, for points of few dimensions: only runs of points whose box a query's ball can touch are ranked.

    ``upto`` bounds the distance at which a neighbour of each query is still of use.
    """
    n, m = len(points), len(queries)
    if n <= 512 or points.shape[1] > 4 or not m:
        return top_k(points, ids, queries, k)
    k = min(k, n)
    order, spans = boxes(points, max(96, 2 * k))
    low, high = np.array([points[order[a:b]].min(0) for a, b in spans]), np.array([points[order[a:b]].max(0) for a, b in spans])
    starts = np.array([a for a, _ in spans])
    sizes = np.array([b - a for a, b in spans])
    near, dist = np.full((m, k), -1, np.int64), np.full((m, k), np.inf)
    q_order, q_spans = boxes(queries, 96)
    for a, b in q_spans:
        mine = q_order[a:b]
        y = queries[mine]
        gap = np.maximum(0.0, np.maximum(low - y.max(0), y.min(0) - high))
        gap = (gap * gap).sum(1)
        # The nearest runs that hold k points together bound the distance of every query's k-th neighbour.
        by = np.argsort(gap, kind="stable")
        first = by[: int(np.searchsorted(np.cumsum(sizes[by]), k)) + 1]
        rows = np.sort(np.concatenate([order[s : s + z] for s, z in zip(starts[first], sizes[first], strict=True)]))
        reach = top_k(points[rows], ids[rows], y, k)[1][:, -1]
        if upto is not None:
            reach = np.minimum(reach, upto[mine])
        touch = np.flatnonzero(gap <= reach.max() * (1 + 1e-12))
        rows = np.sort(np.concatenate([order[s : s + z] for s, z in zip(starts[touch], sizes[touch], strict=True)])) if len(touch) else np.zeros(0, np.int64)
        step = max(1, 1_000_000 // max(1, len(rows)))
        for lo in range(0, len(mine) if len(rows) else 0, step):
            part = mine[lo : lo + step]
            got = top_k(points[rows], ids[rows], queries[part], k)
            near[part, : got[0].shape[1]], dist[part, : got[0].shape[1]] = got
    return near, dist


def farthest(points: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Indices of n points, each the farthest from those before (ties: the first); never one twice."""
    n = min(n, len(points))
    out = np.zeros(n, np.int64)
    if not n:
        return out
    out[0] = start
    least = np.full(len(points), np.inf)
    for i in range(1, n):
        d = np.zeros(len(points))
        for j in range(points.shape[1]):
            d += (points[:, j] - points[out[i - 1], j]) ** 2
        least = np.minimum(least, d)
        least[out[i - 1]] = -1.0
        out[i] = int(least.argmax())
    return out
