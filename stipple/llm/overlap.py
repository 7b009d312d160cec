"""Shapes of evaluation records that are also in the training split, identical or nearly so.

Every shape is written as a normalised text. A passage of it is one tetrahedron of far-apart points,
described by quantities that a turn about the vertical, an offset and one scale leave alone: height
differences and edge lengths relative to one edge, and on which sides points lie, each quantised to a
symbol. A shape has a few passages for each of its points, so a fifth of missing or added points leaves
many of them intact. Both conventions for the vertical axis give a text.

The evaluation passages are written once, in sorted blocks of whole shapes, to the shared folder. Every task
of training shapes describes its shapes once, in passages that also stand with the quantities nearest to the
border of their bin on the other side, and looks them up in each block, which it maps and does not load: an
Aho-Corasick automaton over the heads of all evaluation passages is run over the text of the training
heads, and passages whose head it finds are searched among the sorted ones. So all that two shapes have in
common is found in one task, and neither passages nor what they have in common are shuffled. Only passages
that agree on the turn and the scale between two shapes count together. Pairs above a small coverage are
checked exactly at once: the common passages give poses, those that carry the most points to points are
refined, and the share of points that fall on each other decides.

Copies with the very same points are one representative until the end.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import cut, dropped, folder, partitions, removed, written

BIN = 0.075
LEAST = 128
PROBES = 2
_DELIMITER = "\x01"
_SYMBOLS = 8
_HEAD = 4
_SYMBOL_BITS = 7


def tetrahedra(p: np.ndarray) -> np.ndarray:
    """``(shapes, m, 4)`` indices for ``(shapes, n, 3)`` points: each point, a far one, and two more far from all before.

    Shapes of few points take more of the farthest points, and more choices of the other two, so that all
    have about ``LEAST`` rows or more.
    """
    x, y, z = (p[:, :, None, k] - p[:, None, :, k] for k in range(3))
    d = np.sqrt(x * x + y * y + z * z)
    shapes, n = d.shape[:2]
    depth = max(1, min(3, 40 // n))
    ranks = min(n - 1, -(-LEAST // (n * depth * depth)))
    at = np.arange(shapes)[:, None]
    first = np.broadcast_to(np.arange(n), (shapes, n))

    def farthest(v: np.ndarray, most: int) -> list[np.ndarray]:
        """The places of the ``most`` largest, of equal ones the first."""
        out = [v.argmax(2)]
        if most > 1:
            v = v.copy()
        for _ in range(most - 1):
            np.put_along_axis(v, out[-1][..., None], -np.inf, 2)
            out.append(v.argmax(2))
        return out

    out = []
    for a in farthest(d, ranks):
        near = np.minimum(d, d[at, a])
        for b in farthest(near, depth):
            last = np.minimum(near, d[at, b])
            out += [np.stack([first, a, b, c], 2) for c in farthest(last, depth)]
    return np.concatenate(out, 1)


def quantities(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Invariant quantities of each tetrahedron (third coordinate vertical) and a number for the sides its last two points lie on.

    Also what is not invariant: the directions of two of its edges (256ths of a turn) and the size (16ths of an octave).
    """
    at = np.arange(len(p))[:, None]
    a, b, c, d = (p[at, q[:, :, k]] for k in range(4))

    def length(x: np.ndarray) -> np.ndarray:
        return np.sqrt((x * x).sum(2))

    u, v, w = b - a, c - a, d - a
    edge = np.maximum(length(u), 1e-300)
    values = np.stack([u[..., 2], v[..., 2], w[..., 2], length(v), length(c - b), length(w), length(d - b)], 2) / edge[..., None]
    side = [u[..., 0] * x[..., 1] - u[..., 1] * x[..., 0] > 0 for x in (v, w)]
    turns = np.stack([np.floor(np.arctan2(x[..., 1], x[..., 0]) * (128 / np.pi)).astype(np.int64) & 255 for x in (u, v)], 2)
    return values, side[0] + 2 * side[1], turns, np.floor(np.log2(edge) * 16).astype(np.int64)


def passages(p: np.ndarray, variants: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(shapes, m, symbols)`` passages of ``(shapes, n, 3)`` points, the tetrahedron of each, the tetrahedra, and turn and size of each passage.

    Turn and size are one number, ``size * 256 + turn``. The turn is that of the first edge or, where its
    symbol says that it is upright, of another, so equal passages always mean the same one.
    """
    q = tetrahedra(p)
    v, side, turns, size = quantities(p, q)
    t = v / BIN
    f = np.floor(t).astype(np.int64)
    all_f, number = [f], [np.arange(q.shape[1])]
    if variants:
        part = t - f
        step = np.where(part < 0.5, -1, 1)
        edge = np.argsort(np.minimum(part, 1 - part), axis=2, kind="stable")[..., :PROBES]
        for mask in range(1, 1 << PROBES):
            g = f.copy()
            for k in range(PROBES):
                if mask >> k & 1:
                    at = edge[..., k : k + 1]
                    np.put_along_axis(g, at, np.take_along_axis(g, at, 2) + np.take_along_axis(step, at, 2), 2)
            all_f.append(g)
            number.append(number[0])
    # Symbols 2 to 5 are sides, 8 to 126 quantities: no text has a delimiter or a character of two bytes.
    s = np.clip(np.concatenate(all_f, 1) + 66, 8, 126)
    copies = len(all_f)
    side = np.concatenate([side] * copies, 1)[..., None] + 2
    upright = np.abs((s[..., 0] - 66 + 0.5) * BIN) > 0.9
    turn = np.where(upright, *(np.concatenate([turns[..., k]] * copies, 1) for k in (1, 0)))
    return np.concatenate([side, s], 2).astype(np.uint8), np.concatenate(number), q, np.concatenate([size] * copies, 1) * 256 + turn


def _hashes(symbols: np.ndarray) -> np.ndarray:
    h = np.zeros(symbols.shape[:-1], np.uint64)
    for k in range(symbols.shape[-1]):
        h = (h ^ symbols[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _turned(p: np.ndarray, up: int) -> np.ndarray:
    return p if up == 0 else p[:, [0, 2, 1]]


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """Scale, rotation about the vertical and both centres that carry ``a`` to ``b`` best."""
    a0, b0 = a.mean(0), b.mean(0)
    x, y = a - a0, b - b0
    p = (x[:, 0] * y[:, 0] + x[:, 1] * y[:, 1]).sum()
    q = (x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum()
    h, size = np.hypot(p, q), (x * x).sum()
    if size <= 0:
        return None
    c, s = (p / h, q / h) if h > 0 else (1.0, 0.0)
    turn = np.array([[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]])
    scale = ((x @ turn.T) * y).sum() / size
    return (scale, turn, a0, b0) if scale > 0 else None


def _nearest(y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = (y * y).sum(1)[:, None] + (t * t).sum(1)[None] - 2.0 * y @ t.T
    j = d.argmin(1)
    mutual = d.argmin(0)[j] == np.arange(len(y))
    return j, np.sqrt(np.maximum(d[np.arange(len(y)), j], 0.0)), mutual


def tetrahedra_in_common(e: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Tetrahedra of two shapes with the same passage, each given as ``(sorted hashes, number of each, tetrahedra)``."""
    low, high = np.searchsorted(t[0], e[0]), np.searchsorted(t[0], e[0], side="right")
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    ke = np.repeat(e[1][hit], count)
    kt = t[1][np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    both = np.unique(ke.astype(np.int64) << 32 | kt)
    return e[2][both >> 32], t[2][both & 0xFFFFFFFF]


def described(p: np.ndarray, variants: bool) -> list[tuple[np.ndarray, ...]]:
    """``(sorted hashes, number of each, tetrahedra)`` of each of ``(shapes, n, 3)``."""
    s, number, q, _ = passages(p, variants)
    h = _hashes(s)
    order = np.argsort(h, axis=1, kind="stable")
    return [(h[i][o], number[o], q[i]) for i, o in enumerate(order)]


def carried(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], tolerance: float = 0.03, few: int = 16, poses: int = 1_000) -> list[np.ndarray]:
    """Of each pair ``(e, t, qe, qt)`` the poses (tetrahedra ``qe`` on ``qt``) that carry two fifths of some points near a point.

    All pairs at once, a bounded number of poses at a time: ``few`` points of each ``e``, spread over it.
    """
    count = np.array([len(q) for _, _, q, _ in pairs], int)
    out = [np.zeros(0, int)] * len(pairs)
    if not count.sum():
        return out
    who = np.repeat(np.arange(len(pairs)), count)
    scale, turn, a0, b0 = _fits(np.concatenate([e[q] for e, _, q, _ in pairs]), np.concatenate([t[q] for _, t, _, q in pairs]))
    part = np.stack([e[np.linspace(0, len(e) - 1, few).astype(int)] for e, _, _, _ in pairs])
    # Columns -2 t and |t|^2, so that one product with (y, 1) gives the distances but for |y|^2; none is nearest to what is not there.
    whole = np.zeros((len(pairs), 4, max(len(t) for _, t, _, _ in pairs)))
    whole[:, 3] = np.inf
    for i, (_, t, _, _) in enumerate(pairs):
        whole[i, :3, : len(t)], whole[i, 3, : len(t)] = -2.0 * t.T, (t * t).sum(1)
    near = np.array([(2.0 * tolerance * np.ptp(t, axis=0).max()) ** 2 for _, t, _, _ in pairs])
    good = np.zeros(len(who), bool)
    for lo in range(0, len(who), poses):
        k = slice(lo, lo + poses)
        y = scale[k, None, None] * ((part[who[k]] - a0[k, None]) @ turn[k].transpose(0, 2, 1)) + b0[k, None]
        d = (np.concatenate([y, np.ones((*y.shape[:2], 1))], 2) @ whole[who[k]]).min(2) + (y * y).sum(2)
        good[k] = ((d <= near[who[k], None]).sum(1) >= 0.4 * few) & (scale[k] > 0)
    ends = np.append(0, np.cumsum(count))
    return [np.flatnonzero(good[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def shared_share(e: np.ndarray, t: np.ndarray, qe: np.ndarray | None = None, qt: np.ndarray | None = None, tolerance: float = 0.03) -> float:
    """Share of the larger shape's points that fall on a point of the other after the best alignment.

    Every tetrahedron that both shapes have (``qe`` is ``qt``) gives a pose. Poses are tried from the one
    that carries the most points to points on, until one aligns the shapes; without a common tetrahedron
    the share is 0.
    """
    if qe is None:
        qe, qt = tetrahedra_in_common(described(e[None], False)[0], described(t[None], True)[0])
    if not len(qe):
        return 0.0
    extent = float(np.ptp(t, axis=0).max())
    most, best = max(len(e), len(t)), 0.0
    fits = _fits(e[qe], t[qt])
    # How many points each pose puts near a point, a bounded number of distances at a time.
    close = np.zeros(len(qe), int)
    whole = np.concatenate([-2.0 * t.T, (t * t).sum(1)[None]])
    step = max(1, 200_000 // (len(e) * len(t)))
    for lo in range(0, len(qe), step):
        scale, turn, a0, b0 = (v[lo : lo + step] for v in fits)
        y = scale[:, None, None] * ((e[None] - a0[:, None]) @ turn.transpose(0, 2, 1)) + b0[:, None]
        d = (np.concatenate([y, np.ones((*y.shape[:2], 1))], 2) @ whole).min(2) + (y * y).sum(2)
        close[lo : lo + step] = (d <= (2.0 * tolerance * extent) ** 2).sum(1)
    close[fits[0] <= 0] = 0
    for i in np.argsort(-close, kind="stable"):
        if close[i] < 0.5 * most:
            break
        fit = tuple(v[i] for v in fits)
        share = 0.0
        for r in range(6):
            scale, turn, a0, b0 = fit
            j, d, mutual = _nearest(scale * ((e - a0) @ turn.T) + b0, t)
            good = mutual & (d <= tolerance * extent * (2.0 if r < 3 else 1.0))
            share = max(share, (mutual & (d <= tolerance * extent)).sum() / most)
            # A pose that two refinements leave far from aligned is a chance one.
            fit = _fit(e[good], t[j[good]]) if good.sum() >= 4 and (r < 2 or share >= 0.5) else None
            if fit is None:
                break
        best = max(best, share)
        if best >= 0.75:
            break
    return best


def _fits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_fit`` of many quadruples of points at once; a scale of 0 where there is none."""
    a0, b0 = a.mean(1), b.mean(1)
    x, y = a - a0[:, None], b - b0[:, None]
    p = (x[..., 0] * y[..., 0] + x[..., 1] * y[..., 1]).sum(1)
    q = (x[..., 0] * y[..., 1] - x[..., 1] * y[..., 0]).sum(1)
    h, size = np.hypot(p, q), (x * x).sum((1, 2))
    c, s = np.where(h > 0, p / np.maximum(h, 1e-300), 1.0), np.where(h > 0, q / np.maximum(h, 1e-300), 0.0)
    turn = np.zeros((len(a), 3, 3))
    turn[:, 0, 0], turn[:, 0, 1], turn[:, 1, 0], turn[:, 1, 1], turn[:, 2, 2] = c, -s, s, c, 1.0
    scale = (np.einsum("kij,knj->kni", turn, x) * y).sum((1, 2)) / np.maximum(size, 1e-300)
    return np.maximum(scale, 0.0), turn, a0, b0


def _points(col: pa.Array) -> list[np.ndarray]:
    """Distinct finite points of each row of an array of arrays, in one order."""
    out = []
    for row in col.to_pylist():
        p = [x for x in row or () if x is not None and len(x) == 3 and None not in x]
        p = np.array(p, np.float64).reshape(-1, 3)
        out.append(np.unique(p[np.isfinite(p).all(1)] + 0.0, axis=0))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that what is made of each takes little memory."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _groups(pts: list[np.ndarray], most: int = 200_000) -> Iterator[list[int]]:
    """Numbers of shapes with equally many points, a bounded number of distances at a time."""
    by: dict[int, list[int]] = {}
    for i, p in enumerate(pts):
        by.setdefault(len(p), []).append(i)
    for n, own in by.items():
        step = max(1, most // (n * n))
        for lo in range(0, len(own), step):
            yield own[lo : lo + step]


def _keys(symbols: np.ndarray) -> np.ndarray:
    """A passage's symbols as one number, the first in front."""
    out = np.zeros(symbols.shape[:-1], np.uint64)
    for k in range(symbols.shape[-1]):
        out = out << np.uint64(_SYMBOL_BITS) | symbols[..., k].astype(np.uint64)
    return out


def _heads(keys: np.ndarray) -> np.ndarray:
    """The numbers of the first ``_HEAD`` symbols of sorted passages, each different one once."""
    return np.unique(keys >> np.uint64((_SYMBOLS - _HEAD) * _SYMBOL_BITS))


def _text(heads: np.ndarray) -> np.ndarray:
    """``(heads, _HEAD + 1)`` characters: a delimiter and the symbols of each head."""
    shift = np.arange(_HEAD - 1, -1, -1).astype(np.uint64) * np.uint64(_SYMBOL_BITS)
    symbols = (heads[:, None] >> shift & np.uint64((1 << _SYMBOL_BITS) - 1)).astype(np.uint8)
    return np.concatenate([np.full((len(heads), 1), ord(_DELIMITER), np.uint8), symbols], 1)


def _automaton(heads: np.ndarray) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for w in _text(heads):
        out.add_word(w.tobytes().decode("ascii"), 1)
    out.make_automaton()
    return out


def _least(v: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0))


def _of_runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...`` for ``count[0]`` numbers, then those of the next run."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _described(pts: list[np.ndarray], variants: bool) -> dict[str, np.ndarray]:
    """Passages of shapes in both conventions: ``key``, ``who`` (2 x shape + convention), ``number``, ``turn``, ``size``; ``tets`` of all, those of ``who`` from ``tets_at[who]`` on."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "who", "number", "turn", "size")}
    tets: list[np.ndarray] = [np.zeros((0, 4), int)] * (2 * len(pts))
    for own in _groups(pts):
        p = np.stack([pts[i] for i in own])
        for up in (0, 1):
            s, number, q, pose = passages(p if up == 0 else p[:, :, [0, 2, 1]], variants)
            for i, t in zip(own, q, strict=True):
                tets[2 * i + up] = t
            parts["key"].append(_keys(s).ravel())
            parts["who"].append(np.repeat(np.array(own, np.int32) * 2 + up, s.shape[1]))
            parts["number"].append(np.tile(number.astype(np.int32), len(own)))
            parts["turn"].append((pose & 255).astype(np.uint8).ravel())
            parts["size"].append((pose >> 8).astype(np.int16).ravel())
    out = {k: np.concatenate(v) for k, v in parts.items()}
    return out | {"tets": _least(np.concatenate(tets)), "tets_at": np.cumsum([0, *map(len, tets)])}


def _filesystem(at: str) -> tuple[files.FileSystem, str]:
    """The file system and path of a folder as Spark names it (``file:/x`` too)."""
    return files.FileSystem.from_uri(at[5:] if at.startswith("file:/") and not at.startswith("file://") else at)


def _store(at: str, ids: np.ndarray, pts: list[np.ndarray], stored: np.dtype) -> str:
    """Writes a block of the index and returns its name: arrays that can be mapped, the passages sorted, each different one once with its run of entries."""
    name, d = uuid.uuid4().hex, _described(pts, False)
    order = np.argsort(d["key"], kind="stable")
    key = d.pop("key")[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    d |= {k: _least(d[k][order]) if k in ("who", "number") else d[k][order] for k in ("who", "number", "turn", "size")}
    if len(key) and -128 <= d["size"].min() and d["size"].max() <= 127:
        d["size"] = d["size"].astype(np.int8)
    d |= {"key": key[first], "key_at": np.append(first, len(key)).astype(np.uint32), "heads": _heads(key[first]), "ids": ids}
    d |= {"pts": np.concatenate(pts).astype(stored), "pts_at": np.cumsum([0, *map(len, pts)])}
    fs, root = _filesystem(at)
    fs.create_dir(f"{root}/{name}", recursive=True)
    for k, v in d.items():
        with fs.open_output_stream(f"{root}/{name}/{k}.npy") as f:
            np.lib.format.write_array(f, np.ascontiguousarray(v), allow_pickle=False)
    return name


def _mapped(at: str, name: str, copies: str) -> dict[str, np.ndarray]:
    """A block of the index as mapped arrays; of a folder that is not local a copy is made in ``copies``."""
    fs, root = _filesystem(at)
    if not isinstance(fs, files.LocalFileSystem):
        files.copy_files(f"{root}/{name}", f"{copies}/{name}", source_filesystem=fs)
        root = copies
    names = "who number turn size key key_at heads ids pts pts_at tets tets_at".split()
    return {k: np.load(f"{root}/{name}/{k}.npy", mmap_mode="r").view(np.ndarray) for k in names}


def agreeing(row: np.ndarray, number: np.ndarray, turn: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """For each of ``rows`` pairs how many different passages (``number``) agree on the turn and the steps of size between the two."""
    # Cells of a sixteenth of a turn and an eighth of an octave overlap by half; a passage counts once in a cell.
    most = np.zeros(rows, np.int64)
    if not len(row):
        return most
    size, number = size - size.min(), number.astype(np.int64)
    sizes, numbers = int(size.max()) // 2 + 2, int(number.max()) + 1
    for dt in (0, 8):
        for ds in (0, 1):
            cell = (row * 16 + ((turn + dt & 255) >> 4)) * sizes + (size + ds >> 1)
            cell = np.unique(cell * numbers + number) // numbers
            new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            np.maximum.at(most, cell[new] // (16 * sizes), np.diff(np.append(new, len(cell))))
    return most


def _common(t: dict[str, np.ndarray], ids: np.ndarray, e: dict[str, np.ndarray], distinct: np.ndarray, back: np.ndarray, least: int, most_votes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pairs of training shapes ``t`` and shapes of the block ``e`` with ``least`` agreeing passages or more.

    ``distinct`` are the different passages of ``t`` and ``back`` the place of each passage in them (-1: not to be
    found). Each pair is ``(who of e, who of t, numbers in e, numbers in t)``, those of one pair of
    shapes together, the convention with the most passages first. Whole training shapes at a time.
    """
    place = np.searchsorted(e["key"], distinct)
    found = e["key"][np.minimum(place, len(e["key"]) - 1)] == distinct
    start = e["key_at"][place].astype(np.int64)
    count = np.where(found, e["key_at"][np.minimum(place + 1, len(e["key_at"]) - 1)] - start, 0)
    n = np.where(back >= 0, count[back], 0) if len(count) else np.zeros(len(back), np.int64)
    hit = np.flatnonzero(n)
    hit = hit[np.argsort(t["who"][hit] >> 1, kind="stable")]
    shape, total = t["who"][hit] >> 1, np.cumsum(n[hit])
    ends = np.flatnonzero(np.append(shape[1:] != shape[:-1], True)) + 1 if len(hit) else np.zeros(0, int)
    lo = 0
    while lo < len(hit):
        # As many shapes as have so many votes, one at least.
        k = np.searchsorted(total[ends - 1], (total[lo - 1] if lo else 0) + most_votes, side="right") - 1
        hi = max(int(ends[max(k, 0)]), int(ends[np.searchsorted(ends, lo, side="right")]))
        own, lo = hit[lo:hi], hi
        at, who = _of_runs(start[back[own]], n[own]), np.repeat(own, n[own])
        pair = t["who"][who].astype(np.int64) * (2 * len(e["ids"])) + e["who"][at]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        many = np.diff(np.append(new, len(pair)))
        new, many = new[many >= least], many[many >= least]
        if not len(new):
            continue
        te, ee = pair[new] // (2 * len(e["ids"])), pair[new] % (2 * len(e["ids"]))
        other = ids[te >> 1] != e["ids"][ee >> 1]
        new, many, te, ee = new[other], many[other], te[other], ee[other]
        if not len(new):
            continue
        votes = order[_of_runs(new, many)]
        at, who, row = at[votes], who[votes], np.repeat(np.arange(len(new)), many)
        ke, kt = e["number"][at], t["number"][who]
        turn, size = t["turn"][who].astype(np.int64) - e["turn"][at] & 255, t["size"][who].astype(np.int64) - e["size"][at]
        agree = agreeing(row, ke, turn, size, len(new))
        from_, kept = np.append(0, np.cumsum(many)), np.flatnonzero(agree >= least)
        ee, te, agree = ee[kept], te[kept], agree[kept]
        for i in np.lexsort((ee % 2 * 2 + te % 2, -agree, ee >> 1, te >> 1)):
            own = slice(from_[kept[i]], from_[kept[i] + 1])
            both = np.unique(ke[own].astype(np.int64) << 32 | kt[own])
            yield int(ee[i]), int(te[i]), both >> 32, both & 0xFFFFFFFF


def near_copies(
    records: DataFrame, id_col: str, pos_col: str, train_col: str, least_points: int = 8, least_passages: int = 5, share: float = 0.68, shapes_per_block: int = 12_000, shapes_per_file: int = 1_000
) -> DataFrame:
    """``(eval_id, train_id)``: every evaluation record with each training record of the same shape.

    ``train_col`` is a boolean; null counts as evaluation. ``records`` has one row per id. Records with
    fewer than ``least_points`` different finite points (null, empty and unreadable ones among them) are
    left out. ``least_passages`` is how many passages two records must have in common to be compared,
    ``share`` how much of the larger one must coincide. No partner is dropped: a record with many
    partners is returned with all. Empty tables give an empty result; other columns are ignored. A block of
    the index has about ``shapes_per_block`` evaluation shapes, so that a task can sort it. All is done when
    this returns but for the last joins of ids.
    """
    spark = records.sparkSession
    kind = records.schema[pos_col].dataType
    number = "float" if kind.simpleString() == "array<array<float>>" else "double"
    stored = np.dtype(np.float32 if number == "float" else np.float64)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pts = _points(b.column(2))
            ok = [i for i, p in enumerate(pts) if len(p) >= least_points]
            key = [hashlib.blake2b(pts[i].tobytes(), digest_size=16).hexdigest() for i in ok]
            flat = pa.array([pts[i].ravel().astype(stored) for i in ok], pa.list_(pa.from_numpy_dtype(stored)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), b.column(1).take(pa.array(ok, pa.int64())), pa.array(key, pa.string()), flat], names=["id", "train", "key", "pts"])

    rows = records.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train_col, F.lit(False)).alias("train"), F.col(pos_col).alias("pos"))
    rows = written(rows.mapInArrow(shapes, f"id long, train boolean, key string, pts array<{number}>"))
    named = rows.groupBy("key").agg(F.min("id").alias("rep"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    members = cut(rows.select("id", "train", "key").join(named, "key").select("id", "train", "rep", "in_train", "in_eval"))
    owners = members.filter("id = rep").select("id", "in_train", "in_eval")
    sides = owners.agg(F.count_if("in_eval"), F.count("*")).first()
    parts = max(partitions(spark), -(-sides[1] // shapes_per_file))
    reps = written(rows.select("id", "pts").repartition(parts, "id").join(owners.repartition(parts, "id"), "id").select(F.col("id").alias("rep"), "in_train", "in_eval", "pts"))
    dropped(rows)
    at = folder(spark)

    def points(col: pa.Array) -> list[np.ndarray]:
        return [v.values.to_numpy().reshape(-1, 3).astype(np.float64) for v in col]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pts = [], []

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_store(at, np.concatenate(ids), pts, stored)])], names=["name"])
            ids.clear()
            pts.clear()
            return out

        for b in _slices(batches, 1000):
            ids.append(b.column(0).to_numpy())
            pts.extend(points(b.column(1)))
            if len(pts) >= shapes_per_block:
                yield block()
        if pts:
            yield block()

    blocks = max(4, -(-sides[0] // shapes_per_block))
    names = [r["name"] for r in reps.filter("in_eval").select("rep", "pts").repartition(blocks).mapInArrow(store, "name string").collect()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as copies:
            index = [_mapped(at, name, copies) for name in names]
            automaton = _automaton(np.unique(np.concatenate([e["heads"] for e in index]))) if index else None
            for b in _slices(batches, 500):
                if index:
                    yield from compare(b, index, automaton)

    def compare(b: pa.RecordBatch, index: list[dict[str, np.ndarray]], automaton: ahocorasick.Automaton) -> Iterator[pa.RecordBatch]:
        ids, pts = b.column(0).to_numpy(), points(b.column(1))
        t = _described(pts, True)
        distinct, back = np.unique(t.pop("key"), return_inverse=True)
        heads = _heads(distinct)
        known = np.zeros(len(heads), bool)
        known[[end // (_HEAD + 1) for end, _ in automaton.iter(_text(heads).tobytes().decode("ascii"))]] = True
        known = known[np.searchsorted(heads, distinct >> np.uint64((_SYMBOLS - _HEAD) * _SYMBOL_BITS))]
        distinct, back = distinct[known], np.where(known, np.cumsum(known) - 1, -1)[back]
        for e in index:
            todo = []
            for pair in _common(t, ids, e, distinct, back, least_passages):
                if len(todo) >= 1000 and (pair[0] >> 1, pair[1] >> 1) != (todo[-1][0] >> 1, todo[-1][1] >> 1):
                    yield verified(e, t, ids, pts, todo)
                    todo = []
                todo.append(pair)
            yield verified(e, t, ids, pts, todo)

    def verified(e: dict[str, np.ndarray], t: dict[str, np.ndarray], ids: np.ndarray, pts: list[np.ndarray], todo: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        place, poses = [], []
        for we, wt, ke, kt in todo:
            pe, pt = e["pts"][e["pts_at"][we >> 1] : e["pts_at"][(we >> 1) + 1]], pts[wt >> 1]
            if min(len(pe), len(pt)) >= share * max(len(pe), len(pt)):
                qe, qt = (v["tets"][v["tets_at"][who] + k] for v, who, k in ((e, we, ke), (t, wt, kt)))
                poses.append((_turned(pe.astype(np.float64), we & 1), _turned(pt, wt & 1), qe, qt))
                place.append((we >> 1, wt >> 1))
        keep: list[tuple[int, int]] = []
        for k, (pe, pt, qe, qt), good in zip(place, poses, carried(poses), strict=True):
            if len(good) and not (keep and keep[-1] == k) and shared_share(pe, pt, qe[good], qt[good]) >= share:
                keep.append(k)
        return pa.RecordBatch.from_arrays([pa.array([v[k[i]] for k in keep], pa.int64()) for i, v in enumerate((e["ids"], ids))], names=["e", "t"])

    same = written(reps.filter("in_train").select("rep", "pts").mapInArrow(search, "e long, t long"))
    removed(spark, at)
    dropped(reps)
    same = same.unionByName(members.filter("in_train and in_eval and id = rep").select(F.col("rep").alias("e"), F.col("rep").alias("t")))
    left = members.filter("not train").select(F.col("rep").alias("e"), F.col("id").alias("eval_id"))
    right = members.filter("train").select(F.col("rep").alias("t"), F.col("id").alias("train_id"))
    return same.join(left, "e").join(right, "t").select("eval_id", "train_id")
