"""Normalisation and augmentation of positions, normals and colours.

Per-set statistics are one aggregate joined back; everything else is a projection. Random parameters are
functions of (seed, set) and so the same on every run; sets are transformed independently.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import rng
from stipple.functions.vectors import affine, norm, parts, vector
from stipple.operators.model import with_set_stats

Matrix = list[list[Column | float]]


def _shifted(df: DataFrame, agg, dims: Sequence[int], n: int, per_cloud: bool) -> DataFrame:
    p = parts("pos", n)
    stats = [agg(p[d]).alias(f"__s{d}") for d in dims]
    out = with_set_stats(df, stats, ("cloud_id",) if per_cloud else ())
    moved = [p[d] - F.col(f"__s{d}") if d in dims else p[d] for d in range(n)]
    return out.withColumn("pos", vector(moved)).drop(*[f"__s{d}" for d in dims])


def center_points(df: DataFrame, dims: Sequence[int] = (0, 1, 2), n_dims: int = 3, per_cloud: bool = True) -> DataFrame:
    """Positions less the mean of their set (of all rows unless ``per_cloud``) along ``dims``."""
    return _shifted(df, F.avg, dims, n_dims, per_cloud)


def ground_points(df: DataFrame, dims: Sequence[int] = (0, 1, 2), n_dims: int = 3, per_cloud: bool = True) -> DataFrame:
    """Positions less the minimum of their set along ``dims``."""
    return _shifted(df, F.min, dims, n_dims, per_cloud)


def color_auto_contrast(df: DataFrame, p: float = 0.2, blend: float | None = None, channels: int = 3, seed: int = 0) -> DataFrame:
    """Each channel stretched to its set's range and blended with the original, for each set with probability ``p``.

    ``blend`` 1 is the full stretch, 0 none; None draws it per set from U(0, 1).
    """
    c = parts("color", channels)
    stats = [f(c[k]).alias(f"__{n}{k}") for k in range(channels) for n, f in (("lo", F.min), ("hi", F.max))]
    a = F.lit(float(blend)) if blend is not None else rng.uniform(seed, "blend", "cloud_id")
    out = []
    for k in range(channels):
        lo, hi = F.col(f"__lo{k}"), F.col(f"__hi{k}")
        s = F.lit(1.0) / (F.lit(1e-7) + hi - lo)
        out.append((F.lit(1.0) - a + a * s) * c[k] - a * lo * s)
    stretched = F.when(rng.bernoulli(p, seed, "contrast", "cloud_id"), vector(out)).otherwise(vector(c))
    done = with_set_stats(df, stats).withColumn("color", F.when(F.col("color").isNotNull(), stretched))
    return done.drop(*[f"__{n}{k}" for k in range(channels) for n in ("lo", "hi")])


def scaling_matrix(dims: int, scales: tuple[float, float], uniform: bool, seed: int, key: str = "cloud_id") -> Matrix:
    """Diagonal of U(lo, hi) draws; all equal to the first if ``uniform``."""
    draws = [rng.between(*scales, seed, f"scale{0 if uniform else d}", key) for d in range(dims)]
    return [[draws[i] if i == j else 0.0 for j in range(dims)] for i in range(dims)]


def _product(a: Matrix, b: Matrix) -> Matrix:
    def times(x: Column | float, y: Column | float) -> Column | float:
        if not isinstance(x, Column) and x == 0.0 or not isinstance(y, Column) and y == 0.0:
            return 0.0
        return y if not isinstance(x, Column) and x == 1.0 else x if not isinstance(y, Column) and y == 1.0 else x * y

    def plus(x: Column | float, y: Column | float) -> Column | float:
        return y if not isinstance(x, Column) and x == 0.0 else x if not isinstance(y, Column) and y == 0.0 else x + y

    out: Matrix = []
    for row in a:
        out.append([])
        for j in range(len(b[0])):
            total: Column | float = 0.0
            for x, r in zip(row, b, strict=True):
                total = plus(total, times(x, r[j]))
            out[-1].append(total)
    return out


def rotation_angle(degrees: float | tuple[float, float] | Sequence[float], seed: int, key: str = "cloud_id") -> Column:
    """Radians per set: a number d is U(-|d|, |d|), a tuple its range, a list one of its values."""
    if isinstance(degrees, list):
        pick = F.floor(rng.uniform(seed, "angle", key) * F.lit(float(len(degrees)))).cast("int")
        turn = F.get(F.array(*[F.lit(float(d)) for d in degrees]), pick)
    else:
        low, high = degrees if isinstance(degrees, tuple) else (-abs(degrees), abs(degrees))
        turn = rng.between(low, high, seed, "angle", key)
    return turn * F.lit(math.pi / 180.0)


def rotation_matrix(dims: int, angle: Column, axis: int | Sequence[int] = 2) -> Matrix:
    """One angle about each axis given, the first applied first. In 2-D the axis is ignored.

    The sine above the diagonal is positive for 2-D and for axes 0 and 2, negative for axis 1.
    """
    c, s = F.cos(angle), F.sin(angle)
    if dims == 2:
        return [[c, s], [-s, c]]
    about = {0: [[1.0, 0.0, 0.0], [0.0, c, s], [0.0, -s, c]], 1: [[c, 0.0, -s], [0.0, 1.0, 0.0], [s, 0.0, c]], 2: [[c, s, 0.0], [-s, c, 0.0], [0.0, 0.0, 1.0]]}
    out: Matrix | None = None
    for a in [axis] if isinstance(axis, int) else axis:
        out = about[a] if out is None else _product(about[a], out)
    return out


def _inverse(m: Matrix) -> Matrix:
    """Closed-form inverse of a 2x2 or 3x3 matrix."""
    x = [[v if isinstance(v, Column) else F.lit(float(v)) for v in row] for row in m]
    if len(x) == 2:
        det = x[0][0] * x[1][1] - x[0][1] * x[1][0]
        return [[x[1][1] / det, -x[0][1] / det], [-x[1][0] / det, x[0][0] / det]]

    def minor(i: int, j: int) -> Column:
        r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return x[r[0]][c[0]] * x[r[1]][c[1]] - x[r[0]][c[1]] * x[r[1]][c[0]]

    det = x[0][0] * minor(0, 0) - x[0][1] * minor(0, 1) + x[0][2] * minor(0, 2)
    return [[minor(j, i) * ((-1) ** (i + j)) / det for j in range(3)] for i in range(3)]


def transform_normals(df: DataFrame, m: Matrix, col: str = "norm") -> DataFrame:
    """Unit normals of a surface whose positions map as ``m @ pos``: the inverse transpose, renormalised."""
    n, inv = parts(col, len(m)), _inverse(m)
    moved = affine(n, [[inv[j][i] for j in range(len(m))] for i in range(len(m))])
    size = norm(moved)
    return df.withColumn(col, F.when(F.col(col).isNotNull(), vector([v / size for v in moved])))


def apply_matrix(df: DataFrame, m: Matrix, when: Column | None = None, correct_norm: bool = True) -> DataFrame:
    """``m @ pos`` (and matching normals if there is a ``norm`` column), for rows where ``when`` holds."""
    moved = vector(affine(parts("pos", len(m)), m))
    old = df
    if correct_norm and "norm" in df.columns:
        turned = transform_normals(df.withColumn("__n", F.col("norm")), m)
        df = turned.withColumn("norm", F.when(when, F.col("norm")).otherwise(F.col("__n").cast("array<double>"))).drop("__n") if when is not None else turned
    same = F.col("pos").cast("array<double>")
    out = df.withColumn("pos", moved if when is None else F.when(when, moved).otherwise(same))
    return out.select(*old.columns)


def random_scale(df: DataFrame, scales: tuple[float, float] = (0.8, 1.2), uniform: bool = False, p: float = 1.0, dims: int = 3, seed: int = 0, correct_norm: bool = True) -> DataFrame:
    return apply_matrix(df, scaling_matrix(dims, scales, uniform, seed), None if p >= 1 else rng.bernoulli(p, seed, "do_scale", "cloud_id"), correct_norm)


def random_rotate(df: DataFrame, degrees=360.0, axis: int | Sequence[int] = 2, p: float = 1.0, dims: int = 3, seed: int = 0, correct_norm: bool = True) -> DataFrame:
    return apply_matrix(df, rotation_matrix(dims, rotation_angle(degrees, seed), axis), None if p >= 1 else rng.bernoulli(p, seed, "do_rotate", "cloud_id"), correct_norm)


def random_scale_and_rotate(df: DataFrame, scales: tuple[float, float] = (0.8, 1.2), degrees=360.0, axis: int | Sequence[int] = 2, uniform: bool = False, rotate_prob: float = 1.0, scale_prob: float = 1.0, dims: int = 3, seed: int = 0, correct_norm: bool = True) -> DataFrame:
    """Scaling, then rotation, as one matrix; each is drawn independently per set."""
    turn = F.when(rng.bernoulli(rotate_prob, seed, "do_rotate", "cloud_id"), rotation_angle(degrees, seed)).otherwise(F.lit(0.0))
    do = rng.bernoulli(scale_prob, seed, "do_scale", "cloud_id")
    s = scaling_matrix(dims, scales, uniform, seed)
    s = [[F.when(do, v).otherwise(F.lit(1.0)) if isinstance(v, Column) else v for v in row] for row in s]
    return apply_matrix(df, _product(rotation_matrix(dims, turn, axis), s), None, correct_norm)


def random_shift(df: DataFrame, max_offset: float | Sequence[float] = 1.0, attribute: str = "pos", dims: int = 3, seed: int = 0) -> DataFrame:
    """One offset per set, U(-m, m) per dimension, added to the attribute."""
    most = [max_offset] * dims if isinstance(max_offset, (int, float)) else list(max_offset)
    off = [rng.between(-m, m, seed, f"shift{d}", "cloud_id") for d, m in enumerate(most)]
    return df.withColumn(attribute, vector([x + o for x, o in zip(parts(attribute, dims), off, strict=True)]))


def random_jitter(df: DataFrame, sigma: float = 0.01, clip: float | None = 0.05, dims: int = 3, seed: int = 0) -> DataFrame:
    """Independent normal noise per coordinate, clamped to +-clip."""
    noise = [rng.normal(seed, f"jitter{d}", "cloud_id", "node_id") * F.lit(float(sigma)) for d in range(dims)]
    if clip is not None:
        noise = [F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), x)) for x in noise]
    return df.withColumn("pos", vector([x + e for x, e in zip(parts("pos", dims), noise, strict=True)]))


def mix_sets(df: DataFrame, partners: DataFrame, rotate_partner: bool = False, match_xy: bool = False, seed: int = 0) -> DataFrame:
    """Each set united with a copy of its partner's rows. ``partners(cloud_id, partner_id)`` lists the sets to mix.

    ``origin`` tells the set a row comes from; ids of partner rows are unchanged, so ``(cloud_id, origin,
    node_id)`` is the key. ``rotate_partner`` turns the partner about the third axis by a random angle;
    ``match_xy`` then moves it so that both sets' mean x and y agree. Sets without a partner stay as they are.
    """
    base = df.withColumn("origin", F.col("cloud_id"))
    copy = df.withColumnRenamed("cloud_id", "partner_id").join(partners, "partner_id")
    copy = copy.withColumn("origin", F.col("partner_id"))
    if rotate_partner:
        copy = apply_matrix(copy, rotation_matrix(3, rotation_angle(180.0, seed), 2), correct_norm=False)
    if match_xy:
        own = df.groupBy("cloud_id").agg(*[F.avg(F.get("pos", F.lit(d)).cast("double")).alias(f"__m{d}") for d in (0, 1)])
        theirs = copy.groupBy("cloud_id").agg(*[F.avg(F.get("pos", F.lit(d)).cast("double")).alias(f"__t{d}") for d in (0, 1)])
        p = parts("pos", 3)
        moved = [p[d] + F.col(f"__m{d}") - F.col(f"__t{d}") for d in (0, 1)] + [p[2]]
        copy = copy.join(own.join(theirs, "cloud_id"), "cloud_id").withColumn("pos", vector(moved))
    cols = [c for c in base.columns if c != "pos"]
    return base.select(*cols, F.col("pos").cast("array<double>").alias("pos")).unionByName(copy.select(*cols, F.col("pos").cast("array<double>").alias("pos")))


def mix_partners(sets: DataFrame, p: float, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``(cloud_id, partner_id)``: for each set with probability ``p``, another set: the next in a random order."""
    from stipple.functions.ranks import in_order

    order = in_order(sets.select("cloud_id").distinct().withColumn("__u", rng.uniform(seed, f"order{epoch}", "cloud_id")), ["__u", "cloud_id"], "i")
    n = order.agg(F.count("*").alias("n"))
    after = order.crossJoin(F.broadcast(n)).select(F.col("cloud_id").alias("partner_id"), F.pmod(F.col("i") - 1, F.col("n")).alias("i"))
    return order.join(after, "i").filter(rng.bernoulli(p, seed, f"mix{epoch}", "cloud_id")).select("cloud_id", "partner_id")
