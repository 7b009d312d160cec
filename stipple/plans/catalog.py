"""The catalogue of core queries over the test tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions.rng import uniform_sql as U
from stipple.lineage import cut
from stipple.operators import affine, attributes, density, neighbors, select, voxel
from stipple.operators.apply import apply_mask, apply_selection, select_edges
from stipple.operators.model import as_points, current_rows, filter_sets, finite, ptr, repeat_sets
from stipple.sources import labels
from stipple.sources.readers import read_parquet_objects
from stipple.streaming.loader import batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- point sets


def _table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def scan_points(spark: SparkSession, at: str, *attributes: str) -> DataFrame:
    """Current points with three finite coordinates: ``(cloud_id, node_id, pos, ...)``."""
    rows = current_rows(_table(spark, at, "points"), ["cloud_id", "node_id"], ["pos", *attributes])
    return cut(rows.filter(finite(F.col("pos"), 3)))


def _pts(*attributes: str) -> str:
    """The same as common table expressions ending in ``pts(cloud_id, node_id, x, y_, z, ...)``."""
    kept = "".join(f", max(p.{a}) AS {a}" for a in attributes)
    named = "".join(f", {a}" for a in attributes)
    return f"""
latest AS (SELECT cloud_id, node_id, max(received_at) AS t FROM points WHERE cloud_id IS NOT NULL AND node_id IS NOT NULL GROUP BY cloud_id, node_id),
cur AS (SELECT p.cloud_id, p.node_id, max(p.pos) AS pos{kept} FROM points p JOIN latest l
        ON p.cloud_id = l.cloud_id AND p.node_id = l.node_id AND p.received_at IS NOT DISTINCT FROM l.t GROUP BY p.cloud_id, p.node_id),
pts AS (SELECT cloud_id, node_id, pos[1]::double AS x, pos[2]::double AS y_, pos[3]::double AS z{named} FROM cur
        WHERE len(pos) = 3 AND len([v for v in pos if isfinite(v)]) = 3)"""


def _parts(spark: SparkSession, at: str) -> DataFrame:
    return as_points(_table(spark, at, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_brand")


_PART = "part_pts AS (SELECT p_brand AS cloud_id, p_partkey AS node_id, p_size::double AS x, p_retailprice::double AS y_ FROM part)"


def _events(spark: SparkSession, at: str, *keep: str) -> DataFrame:
    return as_points(_table(spark, at, "events"), "event_id", ["value"], "user_id", keep)


def _vectors(spark: SparkSession, at: str, by_label: bool = False) -> DataFrame:
    return as_points(_table(spark, at, "embeddings"), "vec_id", "embedding", F.col("label").cast("long") if by_label else None)


def _d2(n: int, a: str, b: str) -> str:
    return " + ".join(f"({a}[{i}]::double - {b}[{i}]::double) ** 2" for i in range(1, n + 1))


def _r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select("cloud_id", "node_id", *[F.round(F.get("pos", F.lit(d)).cast("double"), 6).alias(n) for d, n in enumerate(("x", "y_", "z"))], *more)


_KNN_PARTS = f"""
WITH {_PART},
edges AS (SELECT * FROM (
  SELECT a.cloud_id, a.node_id AS dst, b.node_id AS src,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2, b.node_id) AS rank
  FROM part_pts a JOIN part_pts b ON a.cloud_id = b.cloud_id) WHERE rank <= {{k}})"""


# --- neighbours


@_query(f"""
WITH {_pts()}
SELECT cloud_id, dst, rank::int AS rank, src, round(dist, 6) AS dist FROM (
  SELECT a.cloud_id, a.node_id AS dst, b.node_id AS src, sqrt((a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2) AS dist,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2, b.node_id) AS rank
  FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id) WHERE rank <= 8""")
def knn_scans(spark: SparkSession, at: str) -> DataFrame:
    return neighbors.knn(scan_points(spark, at), 8).select("cloud_id", "dst", "rank", "src", *_r6("dist"))


@_query(f"""
SELECT dst, rank::int AS rank, src FROM (
  SELECT a.vec_id AS dst, b.vec_id AS src, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d2(64, "a.embedding", "b.embedding")}, b.vec_id) AS rank
  FROM embeddings a, embeddings b) WHERE rank <= 8""")
def knn_global_emb(spark: SparkSession, at: str) -> DataFrame:
    return neighbors.knn(_vectors(spark, at), 8).select("dst", "rank", "src")


@_query(f"""
SELECT cloud_id, dst, rank::int AS rank, src, round(sqrt(d2), 6) AS dist FROM (
  SELECT a.label::bigint AS cloud_id, a.vec_id AS dst, b.vec_id AS src, {_d2(64, "a.embedding", "b.embedding")} AS d2,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d2(64, "a.embedding", "b.embedding")}, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label) WHERE rank <= 8""")
def knn_percloud_emb(spark: SparkSession, at: str) -> DataFrame:
    return neighbors.knn(_vectors(spark, at, True), 8).select("cloud_id", "dst", "rank", "src", *_r6("dist"))


@_query(f"""
SELECT dst, rank::int AS rank, src FROM (
  SELECT a.vec_id AS dst, b.vec_id AS src, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d2(64, "a.embedding", "b.embedding")}, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_query_points(spark: SparkSession, at: str) -> DataFrame:
    v = _vectors(spark, at)
    return neighbors.knn(v, 5, queries=v.filter("node_id % 20 = 0")).select("dst", "rank", "src")


@_query("""
WITH ev AS (SELECT user_id AS cloud_id, event_id AS node_id, epoch_us(ts)::double / 86400000000.0::double AS x, value AS y_ FROM events)
SELECT cloud_id, dst, rank::int AS rank, src FROM (
  SELECT a.cloud_id, a.node_id AS dst, b.node_id AS src,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2, b.node_id) AS rank
  FROM ev a JOIN ev b ON a.cloud_id = b.cloud_id) WHERE rank <= 8""")
def knn_events(spark: SparkSession, at: str) -> DataFrame:
    days = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("double") / 86400000000.0
    p = as_points(_table(spark, at, "events"), "event_id", [days, F.col("value")], "user_id")
    return neighbors.knn(p, 8).select("cloud_id", "dst", "rank", "src")


@_query(f"""
WITH {_PART}
SELECT dst, rank::int AS rank, src FROM (
  SELECT a.node_id AS dst, b.node_id AS src, row_number() OVER (PARTITION BY a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2, b.node_id) AS rank
  FROM part_pts a, part_pts b) WHERE rank <= 8""")
def knn_global_part(spark: SparkSession, at: str) -> DataFrame:
    p = as_points(_table(spark, at, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return neighbors.knn(p, 8).select("dst", "rank", "src")


@_query(_KNN_PARTS.format(k=25) + "SELECT cloud_id, dst AS node_id, string_agg(src::varchar, ',' ORDER BY rank) AS neighbors FROM edges GROUP BY cloud_id, dst")
def knn_source_graph(spark: SparkSession, at: str) -> DataFrame:
    g = neighbors.source_graph(_parts(spark, at), 25)
    return g.select("cloud_id", "node_id", F.concat_ws(",", F.col("neighbors").cast("array<string>")).alias("neighbors"))


@_query(_KNN_PARTS.format(k=5) + "SELECT cloud_id, src, dst FROM edges")
def knn_unpack_coo(spark: SparkSession, at: str) -> DataFrame:
    return neighbors.to_coo(neighbors.source_graph(_parts(spark, at), 5))


@_query(f"""
WITH {_pts()}
SELECT cloud_id, src, dst FROM (
  SELECT a.cloud_id, a.node_id AS dst, b.node_id AS src, sqrt((a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2) AS dist,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2, b.node_id) AS rank
  FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id) WHERE rank <= 16 AND dist < 0.5""")
def ball_graph(spark: SparkSession, at: str) -> DataFrame:
    return neighbors.ball_graph(scan_points(spark, at), 0.5, 16)


@_query(f"""
WITH {_PART},
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM part_pts) WHERE sel_pos < 5)
SELECT cloud_id, node_id, cluster FROM (
  SELECT a.cloud_id, a.node_id, s.sel_pos AS cluster,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - s.x) ** 2 + (a.y_ - s.y_) ** 2, s.node_id) AS rank
  FROM part_pts a JOIN sel s ON a.cloud_id = s.cloud_id) WHERE rank = 1""")
def nearest_selection_cluster(spark: SparkSession, at: str) -> DataFrame:
    p = _parts(spark, at)
    return neighbors.nearest_selection(p, select.block_select(p, max_num_points=5))


# --- selection

_EV = "ev AS (SELECT user_id AS cloud_id, event_id AS node_id, value FROM events), ev_n AS (SELECT cloud_id, count(*) AS n FROM ev GROUP BY cloud_id)"


def _size_sql(factor: str, most: int, least: int, cap: bool = True) -> str:
    size = f"greatest(least(trunc(n::double * {factor})::bigint, {most}), {least})"
    return f"least({size}, n)" if cap else size


@_query(f"""
WITH {_EV}, placed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM ev)
SELECT cloud_id, node_id, sel_pos FROM placed JOIN ev_n USING (cloud_id) WHERE sel_pos < {_size_sql("0.3::double", 20, 3)}""")
def block_select(spark: SparkSession, at: str) -> DataFrame:
    return select.block_select(_events(spark, at), 20, 3, 0.3)


@_query(f"""
WITH {_EV}, placed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM ev)
SELECT cloud_id, sel_pos AS node_id, value FROM placed JOIN ev_n USING (cloud_id) WHERE sel_pos < {_size_sql("0.5::double", 10**9, 1)}""")
def block_sample(spark: SparkSession, at: str) -> DataFrame:
    ev = _events(spark, at)
    return apply_selection(ev, select.block_select(ev, selection_factor=0.5)).select("cloud_id", "node_id", F.get("pos", F.lit(0)).alias("value"))


def _random_sql(factor: str, most: int, least: int, out: str = "cloud_id, node_id, sel_pos") -> str:
    return f"""
WITH {_EV}, mixed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {U(3, "pick0", "cloud_id", "node_id")}, node_id) - 1 AS r FROM ev),
sizes AS (SELECT cloud_id, {_size_sql(factor, most, least)} AS size FROM ev_n),
chosen AS (SELECT m.cloud_id, m.node_id, m.value FROM mixed m JOIN sizes s ON m.cloud_id = s.cloud_id WHERE m.r < s.size),
placed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM chosen)
SELECT {out} FROM placed"""


@_query(_random_sql("0.4::double", 15, 2))
def random_select(spark: SparkSession, at: str) -> DataFrame:
    return select.random_select(_events(spark, at), 15, 0.4, 2, seed=3)


def _between_sql(low: float, high: float, seed: int, tag: str) -> str:
    return f"({low}::double + {U(seed, tag, 'cloud_id')} * {high - low}::double)"


@_query(_random_sql(_between_sql(0.25, 0.75, 3, "factor0"), 10**7, 1))
def random_select_range(spark: SparkSession, at: str) -> DataFrame:
    return select.random_select(_events(spark, at), selection_factor=(0.25, 0.75), seed=3)


@_query(f"""
WITH {_EV}, sizes AS (SELECT cloud_id, n, {_size_sql("1.5::double", 10**7, 1, False)} AS size FROM ev_n),
draws AS (SELECT cloud_id, n, unnest(range(size)) AS j FROM sizes),
drawn AS (SELECT cloud_id, j, floor({U(3, "draw0", "cloud_id", "j")} * n)::bigint AS i FROM draws),
placed AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS i FROM ev)
SELECT a.cloud_id, p.node_id, row_number() OVER (PARTITION BY a.cloud_id ORDER BY p.node_id, a.j) - 1 AS sel_pos
FROM drawn a JOIN placed p ON a.cloud_id = p.cloud_id AND a.i = p.i""")
def random_select_replacement(spark: SparkSession, at: str) -> DataFrame:
    return select.random_select(_events(spark, at), selection_factor=1.5, replacement=True, seed=3)


@_query(_random_sql("0.4::double", 10**7, 1, "cloud_id, sel_pos AS node_id, value"))
def random_sample(spark: SparkSession, at: str) -> DataFrame:
    ev = _events(spark, at)
    return apply_selection(ev, select.random_select(ev, selection_factor=0.4, seed=3)).select("cloud_id", "node_id", F.get("pos", F.lit(0)).alias("value"))


@_query(_random_sql(f"(CASE WHEN {U(3, 'drop0', 'cloud_id')} < 0.6::double THEN 1.0::double - {U(3, 'ratio0', 'cloud_id')} * 0.9::double ELSE 1.0::double END)", 10**12, 1))
def random_point_dropout(spark: SparkSession, at: str) -> DataFrame:
    return select.random_point_dropout(_events(spark, at), 0.9, 0.6, seed=3)


def _radius_sql(u: str, most: int, ratio: float, radius: float | None, by_distance: bool, out: str = "cloud_id, node_id, sel_pos") -> str:
    near = f"WHERE dist < {radius}::double" if radius else ""
    order = "r" if by_distance else "row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1"
    return f"""
WITH {_pts()},
first AS (SELECT * FROM (SELECT cloud_id, x AS cx, y_ AS cy, z AS cz, count(*) OVER (PARTITION BY cloud_id) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY {u}, node_id) AS o FROM pts) WHERE o = 1),
far AS (SELECT p.*, n, least(trunc(n::double * {ratio}::double)::bigint, {most}) AS most, sqrt((p.x - cx) ** 2 + (p.y_ - cy) ** 2 + (p.z - cz) ** 2) AS dist FROM pts p JOIN first f ON p.cloud_id = f.cloud_id),
near AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY dist, node_id) - 1 AS r FROM far {near}),
kept AS (SELECT *, {order} AS sel_pos FROM near WHERE r < most)
SELECT {out} FROM kept"""


@_query(_radius_sql("node_id", 200, 0.5, 2.0, False))
def radius_select(spark: SparkSession, at: str) -> DataFrame:
    return select.radius_select(scan_points(spark, at), 200, 2.0, 0.5, deterministic=True)


@_query(_radius_sql(U(3, "centre0", "cloud_id", "node_id"), 100, 1.0, 5.0, True))
def radius_select_sorted(spark: SparkSession, at: str) -> DataFrame:
    return select.radius_select(scan_points(spark, at), 100, 5.0, sort_by_distance=True, seed=3)


@_query(_radius_sql("node_id", 150, 1.0, 3.0, False, "cloud_id, sel_pos AS node_id, round(x, 6) AS x, round(y_, 6) AS y_, round(z, 6) AS z"))
def sphere_crop(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    return _xyz(apply_selection(p, select.sphere_select(p, 150, 3.0, deterministic=True)))


_FEATURES = """
latest AS (SELECT node_id, max(received_at) AS t FROM feature_nodes WHERE node_id IS NOT NULL GROUP BY node_id),
feats AS (SELECT f.node_id, max(f.cluster) AS cluster FROM feature_nodes f JOIN latest l ON f.node_id = l.node_id AND f.received_at IS NOT DISTINCT FROM l.t GROUP BY f.node_id),
clustered AS (SELECT node_id, cluster, count(*) OVER (PARTITION BY cluster) AS m, row_number() OVER (PARTITION BY cluster ORDER BY node_id) - 1 AS i FROM feats WHERE cluster IS NOT NULL)"""


def _clustered(spark: SparkSession, at: str) -> DataFrame:
    rows = current_rows(_table(spark, at, "feature_nodes"), ["node_id"], ["cluster"]).filter("cluster is not null")
    return rows.withColumn("cloud_id", F.lit(0).cast("long"))


@_query(f"WITH {_FEATURES} SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS sel_pos FROM clustered WHERE i = 3 % m")
def cluster_select_nth(spark: SparkSession, at: str) -> DataFrame:
    return select.cluster_select(_clustered(spark, at), deterministic=True, pick=3).select("node_id", "sel_pos")


_CLUSTER_RANDOM = f"""WITH {_FEATURES},
best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {U(3, "cluster0", "0", "node_id")} DESC, node_id DESC) AS o FROM clustered)"""


@_query(_CLUSTER_RANDOM + " SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS sel_pos FROM best WHERE o = 1")
def cluster_select_random(spark: SparkSession, at: str) -> DataFrame:
    return select.cluster_select(_clustered(spark, at), seed=3).select("node_id", "sel_pos")


@_query(_CLUSTER_RANDOM + " SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_id, node_id AS original FROM best WHERE o = 1")
def cluster_sample(spark: SparkSession, at: str) -> DataFrame:
    rows = _clustered(spark, at).withColumn("original", F.col("node_id"))
    return apply_selection(rows, select.cluster_select(rows, seed=3)).select("node_id", "original")


def _voxel_sql(size: str) -> str:
    return f"""
WITH {_pts()}, low AS (SELECT min(x) AS lx, min(y_) AS ly, min(z) AS lz FROM pts),
v AS (SELECT p.*, floor((x - lx) / {size})::bigint AS v0, floor((y_ - ly) / {size})::bigint AS v1, floor((z - lz) / {size})::bigint AS v2 FROM pts p, low)"""


@_query(_voxel_sql("0.5::double") + " SELECT cloud_id, node_id, dense_rank() OVER (ORDER BY cloud_id, v2, v1, v0) - 1 AS cluster FROM v")
def voxel_cluster(spark: SparkSession, at: str) -> DataFrame:
    return voxel.voxel_cluster(scan_points(spark, at), 0.5).select("cloud_id", "node_id", "cluster")


@_query(_voxel_sql(_between_sql(0.25, 1.25, 3, "voxel0")) + " SELECT cloud_id, node_id, dense_rank() OVER (ORDER BY cloud_id, v2, v1, v0) - 1 AS cluster FROM v")
def voxel_cluster_range(spark: SparkSession, at: str) -> DataFrame:
    return voxel.voxel_cluster(scan_points(spark, at), (0.25, 1.25), seed=3).select("cloud_id", "node_id", "cluster")


_NTH_VOXEL = """,
n AS (SELECT *, count(*) OVER w AS m, row_number() OVER (w ORDER BY node_id) - 1 AS i FROM v WINDOW w AS (PARTITION BY cloud_id, v0, v1, v2)),
kept AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM n WHERE i = 2 % m)"""


@_query(_voxel_sql("0.5::double") + _NTH_VOXEL + " SELECT cloud_id, node_id, sel_pos FROM kept")
def voxel_select_nth(spark: SparkSession, at: str) -> DataFrame:
    return voxel.voxel_select(scan_points(spark, at), 0.5, deterministic=True, pick=2)


@_query(
    _voxel_sql(f"(CASE WHEN {U(3, 'large0', 'cloud_id')} < 0.5::double THEN {_between_sql(0.5, 1.5, 3, 'voxel0')} ELSE 0.5::double END)")
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, v0, v1, v2 ORDER BY {U(3, "cluster0", "cloud_id", "node_id")} DESC, node_id DESC) AS o FROM v)
SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS node_id, round(x, 6) AS x, round(y_, 6) AS y_, round(z, 6) AS z FROM n WHERE o = 1"""
)
def voxel_sample_random(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    return _xyz(apply_selection(p, voxel.voxel_select(p, (0.5, 1.5), seed=3)))


_FPS = f"""
WITH RECURSIVE pts AS (SELECT label::bigint AS cloud_id, vec_id AS id, embedding AS e FROM embeddings),
s(step, cloud_id, id, e, d, pick) AS (
  SELECT 1, cloud_id, id, e, 'inf'::double, id = min(id) OVER (PARTITION BY cloud_id) FROM pts
  UNION ALL
  SELECT step + 1, cloud_id, id, e, d2, row_number() OVER (PARTITION BY cloud_id ORDER BY d2 DESC, id) = 1 FROM (
    SELECT s.step, s.cloud_id, s.id, s.e, CASE WHEN s.id = q.id THEN -1.0 ELSE least(s.d, {_d2(64, "s.e", "q.e")}) END AS d2
    FROM s JOIN s q ON s.cloud_id = q.cloud_id AND q.pick WHERE s.step < 8))
SELECT cloud_id, id AS node_id, step - 1 AS sel_pos FROM s WHERE pick"""


@_query(_FPS)
def fps_select(spark: SparkSession, at: str) -> DataFrame:
    return select.fps_select(_vectors(spark, at, True), max_num_points=8).select("cloud_id", "node_id", F.col("sel_pos").cast("int").alias("sel_pos"))


_FPS_SCANS = f"""
WITH RECURSIVE {_pts()},
sized AS (SELECT cloud_id, node_id AS id, x, y_, z, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts),
p AS (SELECT cloud_id, id, x, y_, z, least(greatest(trunc(n::double * 0.05::double)::bigint, 1), n) AS size FROM sized),
s(step, cloud_id, id, x, y_, z, size, d, pick) AS (
  SELECT 1, cloud_id, id, x, y_, z, size, 'inf'::double, id = min(id) OVER (PARTITION BY cloud_id) FROM p
  UNION ALL
  SELECT step + 1, cloud_id, id, x, y_, z, size, d2, row_number() OVER (PARTITION BY cloud_id ORDER BY d2 DESC, id) = 1 FROM (
    SELECT s.step, s.cloud_id, s.id, s.x, s.y_, s.z, s.size,
           CASE WHEN s.id = q.id THEN -1.0::double ELSE least(s.d, (s.x - q.x) ** 2 + (s.y_ - q.y_) ** 2 + (s.z - q.z) ** 2) END AS d2
    FROM s JOIN s q ON s.cloud_id = q.cloud_id AND q.pick WHERE s.step < s.size))
SELECT cloud_id, step - 1 AS node_id, round(x, 6) AS x, round(y_, 6) AS y_, round(z, 6) AS z FROM s WHERE pick"""


@_query(_FPS_SCANS)
def fps_sample(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    return _xyz(apply_selection(p, select.fps_select(p, selection_factor=0.05)))


# --- classes by name

_ROOM_NAMES = ", ".join(f"({i}, '{n}', {c[0]}, {c[1]}, {c[2]})" for i, n in enumerate(labels.ROOM_CLASSES) for c in [labels.ROOM_COLORS[n]])


@_query(f"""
WITH {_pts("y")}, names(y, name, r, g, b) AS (VALUES {_ROOM_NAMES}),
scan_t AS (SELECT cloud_id, max(received_at) AS t FROM scans WHERE cloud_id IS NOT NULL GROUP BY cloud_id),
scan AS (SELECT s.cloud_id, max(s.dataset) AS dataset FROM scans s JOIN scan_t t ON s.cloud_id = t.cloud_id AND s.received_at IS NOT DISTINCT FROM t.t GROUP BY s.cloud_id)
SELECT name, count(*) AS nodes, r, g, b FROM pts JOIN scan USING (cloud_id) JOIN names USING (y) WHERE dataset = 'S3DIS' GROUP BY name, r, g, b""")
def class_names(spark: SparkSession, at: str) -> DataFrame:
    """Nodes of the rooms per named class, with the class's colour."""
    scans = current_rows(_table(spark, at, "scans"), ["cloud_id"], ["dataset"]).filter("dataset = 'S3DIS'")
    counts = scan_points(spark, at, "y").join(scans, "cloud_id").groupBy("dataset", "y").agg(F.count("*").alias("nodes"))
    named = counts.join(F.broadcast(labels.class_table(spark)), ["dataset", "y"])
    return named.select("name", "nodes", *[F.col("color")[i].alias(c) for i, c in enumerate("rgb")])


# --- density

_DENSITY = f"""
WITH {_pts()},
far AS (SELECT * FROM (
  SELECT a.cloud_id, a.node_id, sqrt((a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2) AS r,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2, b.node_id) AS rank
  FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id) WHERE rank = 16),
dens AS (SELECT p.cloud_id, p.node_id, CASE WHEN r > 0 THEN {15 / 0.05 / density.unit_ball(2)!r}::double / r ** 2 END AS density
         FROM pts p LEFT JOIN far f ON p.cloud_id = f.cloud_id AND p.node_id = f.node_id)"""


@_query(_DENSITY + " SELECT cloud_id, node_id, round(density, 6) AS density FROM dens")
def estimate_density(spark: SparkSession, at: str) -> DataFrame:
    return density.estimate_density(scan_points(spark, at)).select("cloud_id", "node_id", *_r6("density"))


@_query(_DENSITY + " SELECT cloud_id, round(avg(density), 3) AS density FROM dens GROUP BY cloud_id")
def estimate_density_pooled(spark: SparkSession, at: str) -> DataFrame:
    return density.estimate_density(scan_points(spark, at), pointwise=False).select("cloud_id", F.round("density", 3).alias("density"))


@_query(f"""
WITH {_EV}
SELECT cloud_id, node_id, row_number() OVER (PARTITION BY cloud_id ORDER BY -ln({U(3, "inverse0", "cloud_id", "node_id")} + 0.5::double / 4294967296.0::double) * (1.0::double + abs(value)), node_id) - 1 AS sel_pos FROM ev""")
def inverse_density_select(spark: SparkSession, at: str) -> DataFrame:
    ev = _events(spark, at).withColumn("density", F.lit(1.0) + F.abs(F.get("pos", F.lit(0))))
    return select.inverse_density_select(ev, seed=3)


# --- applying selections


@_query(f"""
WITH {_PART}, kept AS (SELECT cloud_id, count(*) FILTER (WHERE x > 25) AS n FROM part_pts GROUP BY cloud_id)
SELECT cloud_id, n, coalesce(sum(n) OVER (ORDER BY cloud_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM kept""")
def apply_selection_ptr(spark: SparkSession, at: str) -> DataFrame:
    p = _parts(spark, at)
    mask = apply_mask(p.withColumn("m", F.get("pos", F.lit(0)) > 25), "m")
    return ptr(apply_selection(p, mask), p)


@_query(
    _KNN_PARTS.format(k=6)
    + """, sel AS (SELECT cloud_id, node_id, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS sel_pos FROM part_pts WHERE x > 25)
SELECT e.cloud_id, t.sel_pos AS dst, e.rank::int AS rank, coalesce(f.sel_pos, t.sel_pos) AS src
FROM edges e JOIN sel t ON e.cloud_id = t.cloud_id AND e.dst = t.node_id LEFT JOIN sel f ON e.cloud_id = f.cloud_id AND e.src = f.node_id"""
)
def select_knn_edges(spark: SparkSession, at: str) -> DataFrame:
    p = _parts(spark, at)
    mask = apply_mask(p.withColumn("m", F.get("pos", F.lit(0)) > 25), "m")
    return select_edges(neighbors.knn(p, 6), mask)


# --- normalisation and augmentation


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round(x - avg(x) OVER w, 6) AS x, round(y_ - avg(y_) OVER w, 6) AS y_, round(z - avg(z) OVER w, 6) AS z FROM pts WINDOW w AS (PARTITION BY cloud_id)")
def center_points(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.center_points(scan_points(spark, at)))


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round(x - min(x) OVER (), 6) AS x, round(y_ - min(y_) OVER (), 6) AS y_, round(z, 6) AS z FROM pts")
def ground_points_global(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.ground_points(scan_points(spark, at), dims=(0, 1), per_cloud=False))


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round(z - min(z) OVER (PARTITION BY cloud_id), 6) AS height FROM pts")
def extract_heights(spark: SparkSession, at: str) -> DataFrame:
    return attributes.extract_heights(scan_points(spark, at), ground=True).select("cloud_id", "node_id", *_r6("height"))


def _contrast_sql(k: int) -> str:
    c, lo, hi = f"color[{k}]::double", f"min(color[{k}]::double) OVER w", f"max(color[{k}]::double) OVER w"
    s = f"(1.0::double / (1e-7::double + {hi} - {lo}))"
    return f"CASE WHEN {U(3, 'contrast', 'cloud_id')} < 0.7::double THEN (1.0::double - a + a * {s}) * {c} - a * {lo} * {s} ELSE {c} END"


@_query(f"""
WITH {_pts("color")}, drawn AS (SELECT *, {U(3, "blend", "cloud_id")} AS a FROM pts)
SELECT cloud_id, node_id, round({_contrast_sql(1)}, 5) AS r, round({_contrast_sql(2)}, 5) AS g, round({_contrast_sql(3)}, 5) AS b
FROM drawn WINDOW w AS (PARTITION BY cloud_id)""")
def color_autocontrast(spark: SparkSession, at: str) -> DataFrame:
    out = affine.color_auto_contrast(scan_points(spark, at, "color"), p=0.7, seed=3)
    return out.select("cloud_id", "node_id", *[F.round(F.get("color", F.lit(k)), 5).alias(n) for k, n in enumerate("rgb")])


_ANGLE = f"(({-180.0}::double + {U(3, 'angle', 'cloud_id')} * 360.0::double) * {3.141592653589793 / 180.0!r}::double)"


@_query(f"""
WITH {_pts()}, t AS (SELECT *, cos({_ANGLE}) AS c, sin({_ANGLE}) AS s FROM pts)
SELECT cloud_id, node_id, round(c * x + s * y_, 6) AS x, round(-s * x + c * y_, 6) AS y_, round(z, 6) AS z FROM t""")
def random_rotate(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.random_rotate(scan_points(spark, at), 180.0, 2, seed=3))


def _scale_sql(d: int) -> str:
    return f"(0.8::double + {U(3, f'scale{d}', 'cloud_id')} * {1.2 - 0.8!r}::double)"


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round({_scale_sql(0)} * x, 6) AS x, round({_scale_sql(1)} * y_, 6) AS y_, round({_scale_sql(2)} * z, 6) AS z FROM pts")
def random_scale(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.random_scale(scan_points(spark, at), seed=3))


_FUSED = f"""
WITH {_pts()}, t AS (SELECT *,
  CASE WHEN {U(3, "do_rotate", "cloud_id")} < 0.5::double THEN {_ANGLE} ELSE 0.0::double END AS a,
  CASE WHEN {U(3, "do_scale", "cloud_id")} < 0.5::double THEN {_scale_sql(0)} ELSE 1.0::double END AS s0,
  CASE WHEN {U(3, "do_scale", "cloud_id")} < 0.5::double THEN {_scale_sql(1)} ELSE 1.0::double END AS s1,
  CASE WHEN {U(3, "do_scale", "cloud_id")} < 0.5::double THEN {_scale_sql(2)} ELSE 1.0::double END AS s2 FROM pts)
SELECT cloud_id, node_id, round(cos(a) * s0 * x + sin(a) * s1 * y_, 6) AS x, round(-sin(a) * s0 * x + cos(a) * s1 * y_, 6) AS y_, round(s2 * z, 6) AS z FROM t"""


@_query(_FUSED)
def random_scale_and_rotate(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.random_scale_and_rotate(scan_points(spark, at), (0.8, 1.2), 180.0, 2, rotate_prob=0.5, scale_prob=0.5, seed=3))


@_query(f"""
WITH {_pts()}, n AS (SELECT *, sqrt(x * x + y_ * y_ + z * z) AS l FROM pts),
m AS (SELECT *, (x / l) / 2.0::double AS a, (y_ / l) / 0.5::double AS b, z / l AS c FROM n WHERE l > 0)
SELECT cloud_id, node_id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y_, round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM m""")
def transform_normals(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    x = [F.get("pos", F.lit(d)).cast("double") for d in range(3)]
    size = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    unit = p.withColumn("norm", F.array(*[v / size for v in x])).filter(size > 0)
    moved = affine.transform_normals(unit, [[2.0, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 1.0]])
    return _xyz(moved.withColumn("pos", F.col("norm")))


def _shift_sql(d: int) -> str:
    return f"(-1.0::double + {U(3, f'shift{d}', 'cloud_id')} * 2.0::double)"


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round(x + {_shift_sql(0)}, 6) AS x, round(y_ + {_shift_sql(1)}, 6) AS y_, round(z + {_shift_sql(2)}, 6) AS z FROM pts")
def random_shift(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.random_shift(scan_points(spark, at), seed=3))


def _jitter_sql(d: int) -> str:
    u = f"({U(3, f'jitter{d}a', 'cloud_id', 'node_id')} + 0.5::double / 4294967296.0::double)"
    n = f"(sqrt(-2.0::double * ln({u})) * cos(6.283185307179586::double * {U(3, f'jitter{d}b', 'cloud_id', 'node_id')}) * 0.01::double)"
    return f"greatest(-0.02::double, least(0.02::double, {n}))"


@_query(f"WITH {_pts()} SELECT cloud_id, node_id, round(x + {_jitter_sql(0)}, 6) AS x, round(y_ + {_jitter_sql(1)}, 6) AS y_, round(z + {_jitter_sql(2)}, 6) AS z FROM pts")
def random_jitter(spark: SparkSession, at: str) -> DataFrame:
    return _xyz(affine.random_jitter(scan_points(spark, at), 0.01, 0.02, seed=3))


_MIX = f"""
WITH {_pts()}, each_set AS (SELECT cloud_id, row_number() OVER (ORDER BY {U(3, "order0", "cloud_id")}, cloud_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cloud_id FROM pts)),
partners AS (SELECT a.cloud_id, b.cloud_id AS partner_id FROM each_set a JOIN each_set b ON b.i = (a.i + 1) % a.n WHERE {U(3, "mix0", "a.cloud_id")} < 0.5::double)"""


@_query(
    _MIX
    + """ SELECT cloud_id, cloud_id AS origin, node_id, round(x, 6) AS x, round(y_, 6) AS y_, round(z, 6) AS z FROM pts
UNION ALL SELECT r.cloud_id, p.cloud_id AS origin, node_id, round(x, 6) AS x, round(y_, 6) AS y_, round(z, 6) AS z FROM partners r JOIN pts p ON p.cloud_id = r.partner_id"""
)
def mix_sets(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    return _xyz(affine.mix_sets(p, affine.mix_partners(p, 0.5, seed=3)), "origin")


@_query(
    _MIX
    + """, mean AS (SELECT cloud_id, avg(x) AS mx, avg(y_) AS my FROM pts GROUP BY cloud_id)
SELECT cloud_id, cloud_id AS origin, node_id, round(x, 5) AS x, round(y_, 5) AS y_, round(z, 5) AS z FROM pts
UNION ALL SELECT r.cloud_id, p.cloud_id AS origin, node_id, round(x + a.mx - b.mx, 5) AS x, round(y_ + a.my - b.my, 5) AS y_, round(z, 5) AS z
FROM partners r JOIN pts p ON p.cloud_id = r.partner_id JOIN mean a ON a.cloud_id = r.cloud_id JOIN mean b ON b.cloud_id = r.partner_id"""
)
def mix_sets_matched(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at)
    out = affine.mix_sets(p, affine.mix_partners(p, 0.5, seed=3), match_xy=True)
    return out.select("cloud_id", "origin", "node_id", *[F.round(F.get("pos", F.lit(d)).cast("double"), 5).alias(n) for d, n in enumerate(("x", "y_", "z"))])


# --- attributes


@_query(f"WITH {_pts('intensity')} SELECT cloud_id, node_id, concat_ws(',', intensity::double::varchar, y_::varchar) AS x FROM (SELECT cloud_id, node_id, round(intensity, 2) AS intensity, round(x, 3) AS y_ FROM pts WHERE intensity IS NOT NULL)".replace("intensity::double::varchar, y_::varchar", "cast(round(intensity::double * 100) as bigint)::varchar, cast(round(y_ * 1000) as bigint)::varchar").replace("round(intensity, 2) AS intensity, round(x, 3) AS y_", "intensity, x AS y_"))
def attribute_as_feature(spark: SparkSession, at: str) -> DataFrame:
    p = scan_points(spark, at, "intensity").filter("intensity is not null")
    p = p.withColumn("first", F.get("pos", F.lit(0)))
    x = attributes.attribute_as_feature(p, ["intensity", "first"])
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    return x.select("cloud_id", "node_id", F.concat_ws(",", F.round(a * 100).cast("long").cast("string"), F.round(b * 1000).cast("long").cast("string")).alias("x"))


@_query(f"WITH {_pts('y')} SELECT cloud_id, node_id, y FROM pts")
def discard_attributes(spark: SparkSession, at: str) -> DataFrame:
    return attributes.discard_attributes(scan_points(spark, at, "intensity", "y"), "intensity", "pos", "missing")


@_query(f"WITH {_pts('intensity')} SELECT cloud_id, node_id, round(intensity::double * CASE WHEN {U(3, 'scale', 'cloud_id')} < 0.5::double THEN 255.0::double ELSE 1.0::double END, 6) AS intensity FROM pts")
def scale_attribute(spark: SparkSession, at: str) -> DataFrame:
    return attributes.scale_attribute(scan_points(spark, at, "intensity"), "intensity", 255.0, 0.5, seed=3).select("cloud_id", "node_id", *_r6("intensity"))


@_query(f"WITH {_pts('color')} SELECT cloud_id, node_id, round(color[1]::double * CASE WHEN {U(3, 'dropout', 'cloud_id')} < 0.2::double THEN 0.0::double ELSE 1.0::double END, 6) AS r FROM pts")
def attribute_dropout(spark: SparkSession, at: str) -> DataFrame:
    out = attributes.attribute_dropout(scan_points(spark, at, "color"), "color", 0.2, seed=3)
    return out.select("cloud_id", "node_id", F.round(F.get("color", F.lit(0)), 6).alias("r"))


@_query(f"WITH {_pts('y')} SELECT cloud_id, node_id, y FROM pts")
def identity(spark: SparkSession, at: str) -> DataFrame:
    return attributes.compose(attributes.identity, lambda d: d.drop("pos"))(scan_points(spark, at, "y"))


# --- labels, splits, sources, delivery


def _case(lookup: dict[int, int], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {y}" for i, y in sorted(lookup.items())) + " ELSE -1 END"


@_query(f"SELECT p_partkey, ({_case(labels.KITTI_LOOKUP, '((p_partkey * 65537) & 65535) % 260')})::bigint AS kitti, ({_case(labels.NUSCENES_LOOKUP, 'p_size')})::bigint AS nuscenes FROM part")
def label_remap(spark: SparkSession, at: str) -> DataFrame:
    raw = F.pmod((F.col("p_partkey") * 65537).bitwiseAND(F.lit(65535)), F.lit(260))
    return _table(spark, at, "part").select("p_partkey", labels.remap(raw + 65536 * 7, labels.KITTI_LOOKUP, 0xFFFF).alias("kitti"), labels.remap(F.col("p_size"), labels.NUSCENES_LOOKUP).alias("nuscenes"))


@_query(f"SELECT p_partkey, p_size, ({_case(labels.NUSCENES_LOOKUP, 'p_size')})::int AS y FROM part")
def label_remap_join(spark: SparkSession, at: str) -> DataFrame:
    p = _table(spark, at, "part").select("p_partkey", "p_size")
    return labels.remap_join(p, "p_size", labels.label_table(spark, labels.NUSCENES_LOOKUP)).select("p_partkey", "p_size", "y")


_SCANS = """
latest AS (SELECT cloud_id, max(received_at) AS t FROM scans WHERE cloud_id IS NOT NULL GROUP BY cloud_id),
cur AS (SELECT s.cloud_id, max(s.dataset) AS dataset, max(s.sequence) AS sequence, max(s.source_path) AS source_path
        FROM scans s JOIN latest l ON s.cloud_id = l.cloud_id AND s.received_at IS NOT DISTINCT FROM l.t GROUP BY s.cloud_id)"""


@_query(f"""
WITH {_SCANS}
SELECT cloud_id, CASE WHEN dataset = 'S3DIS' THEN
    CASE WHEN regexp_extract(sequence, 'Area_(\\d+)', 1) = '5' THEN 'test' WHEN split_part(source_path, '/', 2) IN ({", ".join(f"'{r}'" for r in labels.ROOM_VALIDATION)}) THEN 'val' ELSE 'train' END
  ELSE CASE WHEN try_cast(sequence AS int) IN (0,1,2,3,4,5,6,7,9,10) THEN 'train' WHEN try_cast(sequence AS int) = 8 THEN 'val' WHEN try_cast(sequence AS int) BETWEEN 11 AND 21 THEN 'pred' END END AS assigned
FROM cur WHERE sequence IS NOT NULL AND source_path IS NOT NULL""")
def split_assign(spark: SparkSession, at: str) -> DataFrame:
    rows = current_rows(_table(spark, at, "scans"), ["cloud_id"], ["dataset", "sequence", "source_path"]).filter("sequence is not null and source_path is not null")
    area = F.regexp_extract("sequence", r"Area_(\d+)", 1)
    room = F.get(F.split("source_path", "/"), F.lit(1))
    drive = F.when(F.col("dataset") != "S3DIS", F.col("sequence"))
    rooms = labels.room_split(F.when(F.col("dataset") == "S3DIS", area).cast("int"), room, 5)
    return rows.select("cloud_id", F.when(F.col("dataset") == "S3DIS", rooms).otherwise(labels.sequence_split(drive)).alias("assigned"))


@_query("""
WITH flat AS (SELECT object_id, received_at, unnest(pos) AS p, generate_subscripts(pos, 1) - 1 AS node_id FROM objects)
SELECT object_id AS cloud_id, node_id, round(p[1]::double, 6) AS x, round(p[3]::double, 6) AS y_, round(p[2]::double, 6) AS z
FROM flat WHERE len(p) = 3 AND isfinite(p[1]) AND isfinite(p[2]) AND isfinite(p[3])""")
def object_points(spark: SparkSession, at: str) -> DataFrame:
    p = read_parquet_objects(spark, f"{at}/objects.parquet").filter(finite(F.col("pos"), 3))
    return _xyz(p)


@_query("SELECT event_id, r AS position, r // 64 AS batch_id, r % 64 AS batch_pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events)")
def loader_batches(spark: SparkSession, at: str) -> DataFrame:
    return batches(_table(spark, at, "events").select("event_id"), ["event_id"], 64)


@_query(f"""
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {U(3, "epoch2", "event_id")}, event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT event_id, r AS position, r // 48 AS batch_id, r % 48 AS batch_pos FROM o WHERE r < n // 48 * 48""")
def loader_batches_shuffled(spark: SparkSession, at: str) -> DataFrame:
    return batches(_table(spark, at, "events").select("event_id"), ["event_id"], 48, shuffle=True, drop_last=True, seed=3, epoch=2)


@_query(f"""
WITH {_pts()}, {_SCANS.replace("latest", "scan_latest").replace("cur AS", "scan_cur AS")}
SELECT p.cloud_id, p.node_id FROM pts p WHERE p.cloud_id IN (SELECT cloud_id FROM scan_cur WHERE dataset = 'S3DIS')""")
def filter_scans(spark: SparkSession, at: str) -> DataFrame:
    scans = current_rows(_table(spark, at, "scans"), ["cloud_id"], ["dataset"])
    return filter_sets(scan_points(spark, at), scans, F.col("dataset") == "S3DIS").select("cloud_id", "node_id")


@_query(f"""
WITH {_SCANS.replace("max(s.dataset)", "max(lower(trim(s.split))) AS split, max(s.dataset)")}
SELECT cloud_id, split, unnest(range(CASE WHEN split = 'train' THEN 3 ELSE 1 END))::int AS loop FROM cur""")
def repeat_training_scans(spark: SparkSession, at: str) -> DataFrame:
    rows = _table(spark, at, "scans").withColumn("split", F.lower(F.trim("split")))
    return repeat_sets(current_rows(rows, ["cloud_id"], ["split"]), 3, F.col("split") == "train")


@_query(f"""
SELECT object_id, received_at, CASE WHEN variant IN ('clean', 'val') THEN 'clean' WHEN regexp_matches(variant, '^({"|".join(labels.CORRUPTIONS)})_[0-4]$') THEN regexp_extract(variant, '^(.*)_[0-4]$', 1) END AS kind,
  CASE WHEN regexp_matches(variant, '^({"|".join(labels.CORRUPTIONS)})_[0-4]$') THEN right(variant, 1)::int END AS level
FROM objects WHERE dataset = 'ShapeNetC'""")
def corruption_levels(spark: SparkSession, at: str) -> DataFrame:
    kind, level = labels.corruption(F.col("variant"))
    return _table(spark, at, "objects").filter("dataset = 'ShapeNetC'").select("object_id", "received_at", kind.alias("kind"), level.alias("level"))


_FLAGSHIP = (
    _voxel_sql("0.5::double")
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, v0, v1, v2 ORDER BY node_id) - 1 AS i FROM v),
kept AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY node_id) - 1 AS node_id, x, y_, z FROM n WHERE i = 0),
far AS (SELECT * FROM (
  SELECT a.cloud_id, a.node_id, sqrt((a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2) AS r,
         row_number() OVER (PARTITION BY a.cloud_id, a.node_id ORDER BY (a.x - b.x) ** 2 + (a.y_ - b.y_) ** 2 + (a.z - b.z) ** 2, b.node_id) AS rank
  FROM kept a JOIN kept b ON a.cloud_id = b.cloud_id) WHERE rank = 16)
SELECT k.cloud_id, count(*) AS n, round(avg(r), 6) AS mean_reach FROM kept k LEFT JOIN far f ON k.cloud_id = f.cloud_id AND k.node_id = f.node_id GROUP BY k.cloud_id"""
)


@_query(_FLAGSHIP)
def flagship(spark: SparkSession, at: str) -> DataFrame:
    """One node per voxel of every scan, its neighbour graph, and the mean distance of the 15th neighbour."""
    p = scan_points(spark, at)
    kept = apply_selection(p, voxel.voxel_select(p, 0.5, deterministic=True, pick=0))
    reach = neighbors.knn(kept, 16).filter("rank = 16").select("cloud_id", F.col("dst").alias("node_id"), "dist")
    joined = kept.select("cloud_id", "node_id").join(reach, ["cloud_id", "node_id"], "left")
    return joined.groupBy("cloud_id").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 6).alias("mean_reach"))
