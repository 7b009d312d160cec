import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.operators import density, select, voxel
from stipple.operators.apply import apply_mask, apply_selection, select_edges
from stipple.operators.model import as_points, current_rows, ptr


def nodes(sel, cloud_id=0):
    return [r["node_id"] for r in sel.filter(F.col("cloud_id") == cloud_id).orderBy("sel_pos").collect()]


def sizes(sel):
    return {r["cloud_id"]: r["count"] for r in sel.groupBy("cloud_id").count().collect()}


def line(n, sets=None):
    return [(float(i), 0.0) for i in range(n)], sets


@pytest.mark.parametrize("factor,least,most,want", [(0.5, 1, 10**9, [25, 15, 10]), (1.0, 1, 20, [20, 20, 20]), (0.1, 4, 10**9, [5, 4, 4]), (2.0, 1, 10**9, [50, 30, 20])])
def test_block_sizes(cloud, factor, least, most, want):
    p = cloud(line(100)[0], [0] * 50 + [1] * 30 + [2] * 20)
    s = select.block_select(p, most, least, factor)
    assert [sizes(s)[c] for c in range(3)] == want
    assert nodes(s, 1) == list(range(want[1]))


def test_positions_across_id_buckets(spark):
    p = spark.range(0, 10).select(F.lit(0).cast("long").alias("cloud_id"), (F.col("id") * 50_000).alias("node_id"), F.array(F.lit(0.0)).alias("pos"))
    s = select.block_select(p, 7)
    assert nodes(s) == [i * 50_000 for i in range(7)] and [r["sel_pos"] for r in s.orderBy("node_id").collect()] == list(range(7))


def test_random_sizes_order_and_repeatability(cloud):
    p = cloud(line(12)[0], [0] * 4 + [1] * 3 + [2] * 5)
    s = select.random_select(p, selection_factor=0.8, seed=5)
    assert sizes(s) == {0: 3, 1: 2, 2: 4}
    for c in range(3):
        assert nodes(s, c) == sorted(set(nodes(s, c)))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, select.random_select(p.repartition(3), selection_factor=0.8, seed=5).collect()))


def test_random_range_and_replacement(cloud):
    p = cloud(line(10)[0])
    assert 3 <= select.random_select(p, selection_factor=(0.3, 0.7), seed=1).count() <= 7
    s = nodes(select.random_select(p, selection_factor=1.5, replacement=True, seed=1))
    assert len(s) == 15 and s == sorted(s) and set(s) <= set(range(10))


def test_point_dropout(cloud):
    p = cloud(line(100)[0])
    assert select.random_point_dropout(p, p=0.0).count() == 100
    assert 10 <= select.random_point_dropout(p, 0.9, 1.0, seed=2).count() <= 100


def test_radius(cloud):
    p = cloud(line(10)[0])
    go = lambda n, **k: nodes(select.radius_select(p, n, deterministic=True, dims=2, **k))
    assert go(4, max_radius=2.5) == [0, 1, 2]
    assert go(10, max_ratio=0.3) == [0, 1, 2]
    assert go(20) == list(range(10))
    assert go(10, max_radius=2.0) == [0, 1], "the radius itself is outside"
    s = select.radius_select(p, 4, sort_by_distance=True, dims=2, seed=3)
    d = [abs(a - nodes(s)[0]) for a in nodes(s)]
    assert d == sorted(d) and len(d) == 4


CLUSTERS = [0, 0, 1, 1, 1, 2, 2, 2, 2, 3]


@pytest.mark.parametrize("pick,want", [(0, [0, 2, 5, 9]), (1, [1, 3, 6, 9]), (2, [0, 4, 7, 9])])
def test_cluster_nth(cloud, pick, want):
    p = cloud(line(10)[0], cluster=CLUSTERS)
    assert nodes(select.cluster_select(p, True, pick)) == want
    assert nodes(select.cluster_select(p, True, epoch=pick)) == want


def test_cluster_wraps_and_random(cloud):
    assert nodes(select.cluster_select(cloud(line(5)[0], cluster=[0, 0, 0, 1, 1]), True, 3)) == [0, 4]
    got = nodes(select.cluster_select(cloud(line(10)[0], cluster=CLUSTERS), seed=4))
    assert [CLUSTERS[i] for i in got] == [0, 1, 2, 3]


def test_voxels(cloud):
    p = cloud([(v, v) for v in (0, 0.1, 1, 1.1, 2)])
    assert [r["cluster"] for r in voxel.voxel_cluster(p, 1.0, 2).orderBy("node_id").collect()] == [0, 0, 1, 1, 2]
    assert nodes(voxel.voxel_select(p, 1.0, True, 0, dims=2)) == [0, 2, 4]
    assert nodes(voxel.voxel_select(p, 1.0, True, 1, dims=2)) == [1, 3, 4]
    assert len(nodes(voxel.voxel_select(p, 1.0, dims=2, seed=1))) == 3


def test_voxel_ids_run_over_sets(cloud):
    p = cloud([(v, v) for v in (0, 0.1, 1, 0, 0.1, 2.1)], [0] * 3 + [1] * 3)
    assert sorted(r["cluster"] for r in voxel.voxel_cluster(p, 1.0, 2).select("cluster").distinct().collect()) == [0, 1, 2, 3]


def greedy(x, n):
    out = [0]
    while len(out) < n:
        d = ((x[:, None] - x[out][None]) ** 2).sum(2).min(1)
        d[out] = -1
        out.append(int(d.argmax()))
    return out


def test_fps(cloud):
    x = np.random.default_rng(5).normal(size=(60, 3))
    assert nodes(select.fps_select(cloud(x), 10)) == greedy(x, 10)
    assert nodes(select.fps_select(cloud(x), 6, rows_per_set=10)) == greedy(x, 6), "in rounds over the table"


def test_fps_finds_both_groups_and_never_repeats(cloud):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(10, 0.1, (30, 2))])
    got = nodes(select.fps_select(cloud(x), 4))
    assert min(got) < 30 <= max(got)
    assert nodes(select.fps_select(cloud([(1, 1)] * 4), 4)) == [0, 1, 2, 3]
    p = cloud([(0, 0), (1, 0), (0, 1), (1, 1)] * 2, [0] * 4 + [1] * 4)
    assert sizes(select.fps_select(p, selection_factor=0.5)) == {0: 2, 1: 2}


def test_density(cloud):
    x = np.random.default_rng(7).normal(size=(50, 2))
    got = [r["density"] for r in density.estimate_density(cloud(x)).orderBy("node_id").collect()]
    r = np.sqrt(np.sort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 15])
    assert np.allclose(got, 15 / 0.05 / np.pi / r**2)
    both = cloud(np.concatenate([x, x]), [0] * 50 + [1] * 50)
    assert density.estimate_density(both, pointwise=False).count() == 2
    assert density.estimate_density(cloud(x[:3])).filter("density is not null").count() == 0


def test_inverse_density_is_a_permutation_and_prefers_low_density(cloud):
    p = cloud(line(200)[0], density=[10.0] * 100 + [1.0] * 100)
    s = select.inverse_density_select(p, seed=1)
    assert sorted(r["sel_pos"] for r in s.collect()) == list(range(200))
    assert sum(n >= 100 for n in nodes(s)[:100]) > 70


def test_apply_selection(cloud, spark):
    p = cloud(line(4)[0], [0, 0, 1, 1], cluster=[5, 5, 6, 6], x=[[1.0], [2.0], [3.0], [4.0]])
    kept = apply_mask(p.withColumn("m", ~((F.col("cloud_id") == 0) & (F.col("node_id") == 1))), "m")
    out = apply_selection(p, kept)
    assert out.columns == ["cloud_id", "node_id", "pos", "x"]
    assert [(r["cloud_id"], r["n"], r["start"]) for r in ptr(out, p).orderBy("cloud_id").collect()] == [(0, 1, 0), (1, 2, 1)]
    assert apply_selection(p, None) is p
    with pytest.raises(ValueError):
        apply_selection(p, kept.filter("false"), strict=True)
    empty = ptr(apply_selection(p, kept.filter("cloud_id = 1")), p)
    assert [(r["n"], r["start"]) for r in empty.orderBy("cloud_id").collect()] == [(0, 0), (2, 0)]


@pytest.mark.parametrize("graph,keep,want", [([[0, 2], [1, 3], [2, 0], [3, 1]], [0, 2], [[0, 1], [1, 0]]), ([[0, 1], [1, 0], [2, 1]], [0, 2], [[0, 0], [1, 1]])])
def test_edges_are_remapped(spark, graph, keep, want):
    edges = spark.createDataFrame([(0, d, r, s) for d, row in enumerate(graph) for r, s in enumerate(row, 1)], "cloud_id long, dst long, rank int, src long")
    sel = spark.createDataFrame([(0, n, i) for i, n in enumerate(keep)], "cloud_id long, node_id long, sel_pos long")
    out = {}
    for r in select_edges(edges, sel).orderBy("dst", "rank").collect():
        out.setdefault(r["dst"], []).append(r["src"])
    assert list(out.values()) == want


def test_current_rows(spark):
    rows = [(1, "a", None, 5), (1, None, 2.0, 5), (1, "z", 9.0, 4), (None, "b", 1.0, 1), (2, None, None, None)]
    got = current_rows(spark.createDataFrame(rows, "k int, s string, v double, received_at int"), ["k"], ["s", "v"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2.0), (2, None, None)]


def test_as_points(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "c")], "id long, a double, b double, c string")
    assert as_points(df, "id", ["a", "b"]).first()["pos"] == [2.0, 3.0]
    assert as_points(df, "id", ["a"], "c").first()["cloud_id"] == "c"


def test_ranks_of_odd_numbers(spark):
    from stipple.functions.ranks import id_bucket, log_bucket, ranked

    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, float("inf"), 0.0, -5.0, float("nan"), 1e-9, 2.9, None])], "c long, i long, v double")
    out = {r["i"]: r["r"] for r in ranked(df, ["c"], ["v", "i"], "r", log_bucket("v")).collect()}
    assert [out[i] for i in (7, 3, 2, 5, 6, 0, 1, 4)] == list(range(8))
    assert ranked(df.withColumn("i", F.lit(None).cast("long")), ["c"], ["v"], "r", id_bucket("i")).count() == 8


def test_ranks_of_ids_that_are_hashes(spark):
    from stipple.functions.ranks import id_bucket, ranked

    df = spark.range(3000).select((F.col("id") % 2).alias("cloud_id"), F.xxhash64("id").alias("node_id"))
    got = {}
    for r in ranked(df, ["cloud_id"], ["node_id"], "i", id_bucket("node_id")).collect():
        got.setdefault(r["cloud_id"], []).append((r["i"], r["node_id"]))
    for rows in got.values():
        rows.sort()
        assert [i for i, _ in rows] == list(range(1500)) and [n for _, n in rows] == sorted(n for _, n in rows)
