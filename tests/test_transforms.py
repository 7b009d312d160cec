import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.functions import rng
from stipple.operators import affine, attributes
from stipple.streaming.loader import batches, deliver

X = np.arange(12, dtype=float).reshape(4, 3)


def pos(df, col="pos"):
    return np.array([r[col] for r in df.orderBy("cloud_id", "node_id").collect()])


def test_center_and_ground(cloud):
    p = cloud(np.concatenate([X, X + 5]), [0] * 4 + [1] * 4)
    assert np.allclose(pos(affine.center_points(p))[:4].mean(0), 0) and np.allclose(pos(affine.center_points(p))[4:].mean(0), 0)
    assert np.allclose(pos(affine.center_points(p, per_cloud=False)).mean(0), 0)
    assert np.allclose(pos(affine.ground_points(p, dims=(2,)))[:, 2][[0, 4]], 0)


def test_heights(cloud):
    p = cloud(np.concatenate([X, X + 5]), [0] * 4 + [1] * 4)
    assert pos(attributes.extract_heights(p, ground=True), "height").tolist() == [0, 3, 6, 9] * 2
    assert pos(attributes.extract_heights(p, 0), "height")[:4].tolist() == [0, 3, 6, 9]


def test_contrast(cloud):
    c = [[0.2, 0.4, 0.1], [0.4, 0.6, 0.2], [0.3, 0.5, 0.3]]
    p = cloud(X[:3], color=c)
    full = pos(affine.color_auto_contrast(p, 1.0, 1.0), "color")
    assert np.allclose(full.min(0), 0, atol=1e-5) and np.allclose(full.max(0), 1, atol=1e-5)
    half = pos(affine.color_auto_contrast(p, 1.0, 0.5), "color")
    assert np.allclose(half, (full + np.array(c)) / 2, atol=1e-6)
    assert np.allclose(pos(affine.color_auto_contrast(p, 1.0, 0.0), "color"), c)
    assert np.allclose(pos(affine.color_auto_contrast(p, 0.0), "color"), c)


def test_scale_and_rotate(cloud):
    unit = np.tile([1.0, 0, 0], (4, 1)).tolist()
    p = cloud(X, norm=unit)
    assert np.allclose(pos(affine.random_scale(p, (2, 2))), X * 2)
    half = pos(affine.random_rotate(p, (180.0, 180.0)))
    assert np.allclose(half, X * [-1, -1, 1], atol=1e-6)
    assert np.allclose(pos(affine.random_rotate(p, (0.0, 0.0))), X)
    r = affine.random_rotate(p, 360, [0, 1, 2], seed=3)
    assert np.allclose(np.linalg.norm(pos(r), axis=1), np.linalg.norm(X, axis=1))
    assert np.allclose(np.linalg.norm(pos(r, "norm"), axis=1), 1)
    assert np.allclose(pos(affine.random_rotate(p, [90.0]))[:, 2], X[:, 2])
    assert np.allclose(pos(affine.random_rotate(p, p=0.0)), X) and np.allclose(pos(affine.random_scale(p, p=0.0), "norm"), unit)


def test_rotation_matrices_turn_the_same_way_as_documented(spark):
    for axis, up, sign in ((0, (1, 2), 1), (1, (0, 2), -1), (2, (0, 1), 1)):
        m = affine.rotation_matrix(3, F.lit(math.pi / 6), axis)
        assert spark.range(1).select(m[up[0]][up[1]]).first()[0] == pytest.approx(sign * 0.5)


def test_fused_equals_steps(cloud):
    p = cloud(X)
    fused = pos(affine.random_scale_and_rotate(p, (0.5, 1.5), 180, 2, seed=9))
    steps = pos(affine.random_rotate(affine.random_scale(p, (0.5, 1.5), seed=9), 180, 2, seed=9))
    assert np.allclose(fused, steps)


def test_normals(cloud):
    s = 1 / math.sqrt(2)
    p = cloud(X[:1], norm=[[s, s, 0.0]])
    want = np.array([0.5, 1, 0]) / np.linalg.norm([0.5, 1, 0])
    m = [[2.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    there = affine.transform_normals(p, m)
    assert np.allclose(pos(there, "norm")[0], want)
    back = affine.transform_normals(there, [[0.5, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
    assert np.allclose(pos(back, "norm")[0], [s, s, 0])


def test_shift_and_jitter(cloud):
    p = cloud(np.concatenate([X, X]), [0] * 4 + [1] * 4)
    d = pos(affine.random_shift(p, [1, 2, 0], seed=4)) - np.concatenate([X, X])
    assert np.allclose(d[:4], d[0]) and not np.allclose(d[0], d[4]) and np.allclose(d[:, 2], 0) and (np.abs(d) <= [1, 2, 0]).all()
    j = pos(affine.random_jitter(p, 0.3, 0.5, seed=4)) - np.concatenate([X, X])
    assert (np.abs(j) <= 0.5 + 1e-12).all() and len(np.unique(j.round(9))) > 10


def test_mix(cloud, spark):
    p = cloud(np.concatenate([X, X + 7]), [0] * 4 + [1] * 4)
    out = affine.mix_sets(p, spark.createDataFrame([(0, 1)], "cloud_id long, partner_id long"), rotate_partner=True, match_xy=True, seed=1)
    assert out.count() == 12 and out.filter("cloud_id = 0 and origin = 1").count() == 4
    mixed = np.array([r["pos"] for r in out.filter("origin = 1 and cloud_id = 0").collect()])
    assert np.allclose(mixed.mean(0)[:2], X.mean(0)[:2]) and np.allclose(sorted(mixed[:, 2]), sorted(X[:, 2] + 7))
    assert affine.mix_partners(p, 1.0).filter("cloud_id = partner_id").count() == 0


def test_attributes(cloud):
    p = cloud(X, h=[1.0, 2.0, 3.0, 4.0], x=[[9.0], [8.0], [7.0], [6.0]])
    assert pos(attributes.attribute_as_feature(p, ["pos", "h"]), "x")[0].tolist() == [0, 1, 2, 1]
    out = attributes.attribute_as_feature(p, ["h"], overwrite=False)
    assert pos(out, "x")[1].tolist() == [8, 2] and "h" not in out.columns
    assert "h" in attributes.attribute_as_feature(p, ["h"], drop=False).columns
    assert attributes.discard_attributes(p, "h", "nothing").columns == ["cloud_id", "node_id", "pos", "x"]
    assert pos(attributes.scale_attribute(p, "h", 2.0), "h").tolist() == [2, 4, 6, 8]
    assert pos(attributes.attribute_dropout(p, "x", 1.0), "x").sum() == 0
    assert pos(attributes.attribute_dropout(p, "x", 0.0), "x").sum() == 30
    assert attributes.identity(p) is p


def test_random_numbers_do_not_depend_on_partitions(spark):
    u = lambda df: sorted((r["id"], r["u"]) for r in df.select("id", rng.uniform(1, "t", "id").alias("u")).collect())
    a = u(spark.range(200))
    assert a == u(spark.range(200).repartition(7)) and all(0 <= v < 1 for _, v in a) and 0.4 < np.mean([v for _, v in a]) < 0.6
    n = [r[0] for r in spark.range(2000).select(rng.normal(1, "t", "id")).collect()]
    assert abs(np.mean(n)) < 0.1 and abs(np.std(n) - 1) < 0.1


@pytest.mark.parametrize("n,size", [(20, 1), (20, 4), (17, 5)])
def test_batches_in_order(spark, n, size):
    got = list(deliver(batches(spark.range(n).withColumnRenamed("id", "item"), ["item"], size)))
    assert [[r["item"] for r in b] for b in got] == [list(range(i, min(i + size, n))) for i in range(0, n, size)]


def test_batches_shuffle_and_drop(spark):
    items = spark.range(23).withColumnRenamed("id", "item")
    a = [r["item"] for b in deliver(batches(items, ["item"], 5, shuffle=True, seed=1)) for r in b]
    b = [r["item"] for b in deliver(batches(items, ["item"], 5, shuffle=True, seed=1, epoch=1)) for r in b]
    assert sorted(a) == sorted(b) == list(range(23)) and a != b and a != sorted(a)
    assert batches(items, ["item"], 5, drop_last=True).count() == 20
    with pytest.raises(ValueError):
        batches(items, ["item"], 0)


def test_errors_reach_the_consumer(spark):
    bad = spark.range(10).withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("broken item"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken item"):
        list(deliver(batches(bad.select(F.col("id").alias("item"), "v"), ["item"], 2)))
