import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.functions import kernels
from stipple.operators import neighbors
from stipple.operators.select import block_select

CUBE = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def brute(x, k, q=None):
    q = x if q is None else q
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    return np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]


def graph(df, k):
    out = {}
    for r in df.orderBy("dst", "rank").collect():
        out.setdefault(r["dst"], []).append(r["src"])
    return [v for _, v in sorted(out.items())]


@pytest.mark.parametrize("dims", [2, 3, 20])
def test_knn_equals_brute_force(spark, cloud, dims):
    x = np.random.default_rng(dims).normal(size=(100, dims))
    assert graph(neighbors.knn(cloud(x), 5), 5) == brute(x, 5).tolist()


def test_knn_in_tiles_equals_one_tile(spark, cloud):
    x = np.random.default_rng(1).normal(size=(300, 3))
    p = cloud(x)
    assert graph(neighbors.knn(p, 4, query_block=50, point_block=70), 4) == brute(x, 4).tolist()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_knn_of_a_set_in_slabs_equals_brute_force(spark, cloud, dims):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(500, dims)), np.zeros((90, dims)), r.normal(size=(10, dims)) * 50]).round(2)
    p = cloud(np.concatenate([x, x[:40]]), [0] * 600 + [1] * 40)
    got = neighbors.knn(p, 4, rows_per_task=80)
    assert graph(got.filter("cloud_id = 0"), 4) == brute(x, 4).tolist()
    assert graph(got.filter("cloud_id = 1"), 4) == brute(x[:40], 4).tolist()
    q = cloud(r.normal(size=(30, dims)) * 3)
    assert graph(neighbors.knn(p, 5, queries=q, rows_per_task=80), 5) == brute(x, 5, np.array([v["pos"] for v in q.orderBy("node_id").collect()])).tolist()


def test_ranking_by_boxes_equals_ranking_all():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(3000, 2)), r.integers(0, 4, (1000, 2))]).round(1)
    y = np.concatenate([x[:700], r.normal(size=(50, 2)) * 9])
    a, b = kernels.near_k(x, np.arange(4000), y, 7), kernels.top_k(x, np.arange(4000), y, 7)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_knn_kernel_equals_window(spark, cloud):
    x = np.random.default_rng(2).normal(size=(40, 2)).round(1)
    p = cloud(x, [i % 2 for i in range(40)])
    cols = ("cloud_id", "dst", "rank", "src")
    assert rows(neighbors.knn(p, 3), *cols) == rows(neighbors.knn_window(p, 3, 2), *cols)


def test_k_is_one_gives_the_node_itself(cloud):
    assert rows(neighbors.knn(cloud(CUBE), 1), "dst", "src") == [(i, i) for i in range(8)]


def test_k_is_n_gives_everything(cloud):
    got = rows(neighbors.knn(cloud(CUBE), 8), "dst", "src")
    assert got == [(i, j) for i in range(8) for j in range(8)]


def test_coincident_points_tie_to_smaller_id(cloud):
    assert graph(neighbors.knn(cloud([(0, 0), (0, 0), (5, 5), (5, 5)]), 2), 2) == [[0, 1], [0, 1], [2, 3], [2, 3]]


def test_many_coincident_points(cloud):
    got = graph(neighbors.knn(cloud([(1, 1)] * 60 + [(2, 2)]), 3), 3)
    assert got[:60] == [[0, 1, 2]] * 60 and got[60] == [60, 0, 1]


def test_sets_are_separate(cloud):
    p = cloud([*CUBE[:4], *[(x + 10, y, z) for x, y, z in CUBE[:4]]], [0] * 4 + [1] * 4)
    assert neighbors.knn(p, 3).groupBy("cloud_id", "dst").count().filter("count <> 3").count() == 0


def test_small_sets_and_strict(cloud):
    p = cloud([(0, 0), (1, 0), (2, 0)], [0, 0, 1])
    assert neighbors.knn(p, 2).filter("cloud_id = 1").count() == 1
    with pytest.raises(ValueError):
        neighbors.knn(p, 2, strict=True)
    with pytest.raises(ValueError):
        neighbors.knn(p, 1, queries=p.filter("false"), strict=True)


def test_separate_queries(cloud):
    x, q = np.random.default_rng(3).normal(size=(50, 3)), np.random.default_rng(4).normal(size=(20, 3))
    assert graph(neighbors.knn(cloud(x), 4, queries=cloud(q)), 4) == brute(x, 4, q).tolist()


def test_empty_points(cloud):
    assert neighbors.knn(cloud(CUBE).filter("false"), 3).count() == 0


def test_ball_graph(cloud):
    p = cloud([(0, 0), (1, 0), (0, 1), (1, 1), (2, 2)])
    assert rows(neighbors.ball_graph(p, 0.1, 5), "src", "dst") == [(i, i) for i in range(5)]
    assert (1, 0) in rows(neighbors.ball_graph(p, 1.1, 5), "src", "dst")
    assert (1, 0) not in rows(neighbors.ball_graph(p, 1.0, 5), "src", "dst"), "the radius itself is outside"


def test_dense_and_coo(cloud):
    p = cloud([(0, 0), (1, 0), (3, 0)])
    dense = neighbors.source_graph(p, 2)
    assert rows(dense, "node_id", "neighbors") == [(0, [0, 1]), (1, [1, 0]), (2, [2, 1])]
    assert rows(neighbors.to_coo(dense), "src", "dst") == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 2)]


def test_nearest_selection(cloud):
    p = cloud([(0, 0), (1, 0), (9, 0), (10, 0)])
    s = block_select(p, 2).withColumn("node_id", F.when(F.col("sel_pos") == 0, 0).otherwise(3))
    assert rows(neighbors.nearest_selection(p, s), "node_id", "cluster") == [(0, 0), (1, 0), (2, 1), (3, 1)]
