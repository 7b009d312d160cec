import numpy as np
import pytest
from pyspark.sql import functions as F

from stipple.sources import labels, readers


def test_kitti(spark, tmp_path):
    for seq in ("00", "08", "11"):
        d = tmp_path / "sequences" / seq
        (d / "velodyne").mkdir(parents=True)
        (d / "labels").mkdir()
        np.arange(8, dtype="<f4").tofile(d / "velodyne" / "000000.bin")
        if seq != "11":
            np.array([10 | 3 << 16, 2], "<u4").tofile(d / "labels" / "000000.label")
    got = readers.read_kitti(spark, str(tmp_path)).orderBy("sequence", "node_id").collect()
    assert [(r["sequence"], r["split"], r["node_id"], r["pos"], r["intensity"], r["y"]) for r in got] == [
        (s, sp, n, [4.0 * n, 4.0 * n + 1, 4.0 * n + 2], 4.0 * n + 3, y) for s, sp in (("00", "train"), ("08", "val")) for n, y in ((0, 0), (1, -1))
    ]
    assert {r["y"] for r in readers.read_kitti(spark, str(tmp_path), "pred").collect()} == {-1}


def test_nuscenes(spark, tmp_path):
    np.array([1, 2, 3, 255, 0, 4, 5, 6, 51, 1], "<f4").tofile(tmp_path / "a.pcd.bin")
    np.array([9, 1], "u1").tofile(tmp_path / "a_lidarseg.bin")
    m = spark.createDataFrame([(1, "train", "a.pcd.bin", "a_lidarseg.bin")], "cloud_id long, split string, lidar_path string, label_path string")
    got = readers.read_nuscenes(spark, str(tmp_path), m).orderBy("node_id").collect()
    assert [(r["pos"], round(r["intensity"], 6), r["y"]) for r in got] == [([1, 2, 3], 1.0, 0), ([4, 5, 6], 0.2, -1)]


def test_rooms(spark, tmp_path):
    for area, room in ((1, "office_1"), (5, "lobby_2")):
        d = tmp_path / f"Area_{area}" / room / "Annotations"
        d.mkdir(parents=True)
        (d / "chair_1.txt").write_text("1 2 3 255 0 51\nNaN 2 3 1 1 1\n")
        (d / "stairs_1.txt").write_text("4 5 6 0 0 0\n")
    got = readers.read_rooms(spark, str(tmp_path)).orderBy("area", "node_id").collect()
    assert [(r["area"], r["split"], r["node_id"], r["pos"], r["y"]) for r in got] == [(a, s, n, p, y) for a, s in ((1, "val"), (5, "test")) for n, p, y in ((0, [1, 2, 3], 7), (1, [4, 5, 6], 12))]
    assert np.allclose(got[0]["color"], [1, 0, 0.2])


def test_off(spark, tmp_path):
    for i in (0, 80):
        (tmp_path / f"tr_reg_{i:03d}.off").write_text("OFF\n3 1 0\n0 1 2\n3 4 5\n6 7 8\n3 0 1 2\n")
    points, faces = readers.read_off(spark, str(tmp_path), num_loops=2)
    got = points.orderBy("cloud_id", "loop", "node_id").collect()
    assert len(got) == 9 and got[0]["pos"] == [2, 0, 1] and [r["y"] for r in got[:3]] == [0, 1, 2]
    assert {(r["cloud_id"], r["split"], r["loop"]) for r in got} == {(0, "train", 0), (0, "train", 1), (80, "test", 0)}
    assert faces.count() == 2 and faces.first()["v"] == [0, 1, 2]


def test_hdf5_is_optional(spark, tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            readers.read_hdf5_objects(spark, str(tmp_path))


def stored(path, **arrays):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        np.savez(f, **arrays)


def test_named_object_readers(spark, tmp_path):
    def fields(content):
        import io

        return dict(np.load(io.BytesIO(content)))

    data = np.arange(12.0).reshape(2, 2, 3)
    for name, y in (("ply_data_train0", 1), ("ply_data_train1", 2), ("ply_data_test0", 3)):
        stored(tmp_path / "m" / f"{name}.h5", data=data, label=np.full((2, 1), y))
    train = readers.read_modelnet40(spark, str(tmp_path / "m"), "trainval", fields=fields).collect()
    assert len(train) == 8 and {r["y"] for r in train} == {1, 2} and len({r["cloud_id"] for r in train}) == 4
    assert min(r["pos"] for r in train) == [0, 2, 1] and {r["split"] for r in train} == {"train"}
    assert {r["y"] for r in readers.read_modelnet40(spark, str(tmp_path / "m"), "test", fields=fields).collect()} == {3}

    for name in ("clean", "scale_4"):
        stored(tmp_path / "c" / f"{name}.h5", data=data, label=np.array([5, 6]), pid=np.array([[0, 1], [2, 3]]))
    got = readers.read_modelnet_c(spark, str(tmp_path / "c"), "scale_4", fields=fields).collect()
    assert {(r["corruption"], r["level"], r["y"]) for r in got} == {("scale", 4, 5), ("scale", 4, 6)}
    parts = sorted((r["y"], r["category"], r["pos"]) for r in readers.read_shapenet_c(spark, str(tmp_path / "c"), "val", fields=fields).collect())
    assert parts == [(0, 5, [0, 1, 2]), (1, 5, [3, 4, 5]), (2, 6, [6, 7, 8]), (3, 6, [9, 10, 11])]
    with pytest.raises(ValueError):
        readers.read_modelnet_c(spark, str(tmp_path / "c"), "train", fields=fields)

    stored(tmp_path / "s" / "h5_files" / "main_split_nobg" / "test_objectdataset_augmentedrot.h5", data=data, label=np.array([7, 8]))
    got = readers.read_scanobject(spark, str(tmp_path / "s"), "test", "PB_T50_R", fields=fields).collect()
    assert {(r["variant"], r["split"], r["y"]) for r in got} == {("PB_T50_R", "test", 7), ("PB_T50_R", "test", 8)}
    with pytest.raises(ValueError):
        readers.read_scanobject(spark, str(tmp_path / "s"), "test", "PB_T75", fields=fields)


def test_steps_of_readers(spark, tmp_path):
    for i, n in ((0, 3), (80, 2)):
        (tmp_path / f"tr_reg_{i:03d}.off").write_text(f"OFF\n{n} 0 0\n" + "0 1 2\n" * n)
    points, _ = readers.read_off(spark, str(tmp_path), pre_filter=(F.col("n") > 2) & (F.col("split") == "train"), pre_transform=lambda p: p.withColumn("z", F.lit(1)), transform=lambda p: p.withColumn("z", F.col("z") + 1))
    assert {(r["cloud_id"], r["z"]) for r in points.collect()} == {(0, 2)}


def test_class_table(spark):
    rows = labels.class_table(spark).collect()
    assert len(rows) == 19 + 13 + 15 and {(r["name"], r["written"]) for r in rows if r["dataset"] == "SemanticKITTI" and r["y"] == 0} == {("car", 10)}


def test_parquet_objects_and_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0]], 4, "d", "train")], "object_id long, pos array<array<float>>, y long, dataset string, split string")
    df.write.parquet(str(tmp_path / "o"))
    p = readers.read_parquet_objects(spark, str(tmp_path / "o"))
    assert p.first()["pos"] == [1, 3, 2]
    readers.write_points(p, str(tmp_path / "out"))
    assert (tmp_path / "out" / "dataset=d" / "split=train").exists()


def test_labels_and_splits(spark):
    ids = spark.createDataFrame([(10,), (252,), (2,), (40 | 7 << 16,), (None,)], "l long")
    assert [r[0] for r in ids.select(labels.remap(F.col("l"), labels.KITTI_LOOKUP, 0xFFFF)).collect()] == [0, 0, -1, 8, -1]
    small = spark.createDataFrame([(9,), (77,)], "id int")
    assert sorted(r["y"] for r in labels.remap_join(small.withColumnRenamed("id", "raw"), "raw", labels.label_table(spark, labels.NUSCENES_LOOKUP)).collect()) == [-1, 0]
    assert len(labels.corruption_splits()) == 36 and labels.split_names("trainval", ["train", "val", "test"]) == ["train", "val"]
    assert set(labels.KITTI_LOOKUP.values()) == set(range(-1, 19)) and set(labels.NUSCENES_LOOKUP) == set(range(32))
    rooms = spark.createDataFrame([(6, "office_1"), (1, "office_1"), (1, "lobby_1")], "a int, r string")
    assert [r[0] for r in rooms.select(labels.room_split(F.col("a"), F.col("r"), 0)).collect()] == ["test", "val", "train"]


def test_filter_repeat_and_corruption(spark):
    from stipple.operators.model import filter_sets, repeat_sets

    p = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "cloud_id long, node_id long")
    c = spark.createDataFrame([(1, "train"), (2, "test"), (2, "test")], "cloud_id long, split string")
    assert filter_sets(p, c, F.col("split") == "test").count() == 1
    assert sorted((r["cloud_id"], r["loop"]) for r in repeat_sets(c, 2, F.col("split") == "train").collect()) == [(1, 0), (1, 1), (2, 0), (2, 0)]
    s = spark.createDataFrame([("clean",), ("add_local_3",), ("PB_T25",), (None,)], "s string")
    assert [tuple(r) for r in s.select(*labels.corruption(F.col("s"))).collect()] == [("clean", None), ("add_local", 3), (None, None), (None, None)]
