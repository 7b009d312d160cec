"""Readers from dataset files to points, one row per node.

Binary and mesh files are read with the binaryFile source and decoded in Arrow functions, text files with
the csv source, so listing, splitting and retries are Spark's. ``cloud_id`` is the hash of a file's path
below the root unless a manifest gives one; ``node_id`` is the position in the file.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stipple.functions.ranks import ranked
from stipple.operators.model import filter_sets
from stipple.sources import labels

POINTS = "path string, node_id long, pos array<float>"


def _steps(reader):
    """Adds to a reader what is done with its points before they are returned.

    ``pre_filter`` is a predicate over one row a set: its number of nodes ``n`` and the columns that do not
    belong to nodes. ``pre_transform`` and then ``transform`` are functions of the points.
    """

    @functools.wraps(reader)
    def read(*args, pre_filter=None, pre_transform=None, transform=None, **more):
        out = reader(*args, **more)
        points, rest = (out[0], out[1:]) if isinstance(out, tuple) else (out, None)
        if pre_filter is not None:
            own = [c for c in points.columns if c not in ("cloud_id", "node_id", "pos", "color", "intensity", "y")]
            sets = points.groupBy("cloud_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in own])
            points = filter_sets(points, sets, pre_filter)
        for step in (pre_transform, transform):
            points = step(points) if step is not None else points
        return points if rest is None else (points, *rest)

    return read


def _decoded(spark: SparkSession, root: str, pattern: str, schema: str, decode: Callable[[bytes], dict[str, list]]) -> DataFrame:
    """Rows of every file under ``root`` whose name matches: the file's path and what ``decode`` makes of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cols = decode(content)
                n = len(cols["node_id"])
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values())], names=["path", *cols])

    return files.mapInArrow(run, schema)


def _lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def _lidar(spark: SparkSession, root: str, width: int, factor: float) -> DataFrame:
    def decode(content: bytes) -> dict:
        x = np.frombuffer(content[: len(content) // (4 * width) * 4 * width], "<f4").reshape(-1, width)
        return {"node_id": np.arange(len(x)), "pos": _lists(x[:, :3]), "intensity": x[:, 3] * np.float32(factor)}

    return _decoded(spark, root, "*.bin", POINTS + ", intensity float", decode)


def _lidar_labels(spark: SparkSession, root: str, pattern: str, kind: str) -> DataFrame:
    def decode(content: bytes) -> dict:
        x = np.frombuffer(content, kind).astype(np.int64)
        return {"node_id": np.arange(len(x)), "label": x}

    return _decoded(spark, root, pattern, "path string, node_id long, label long", decode)


@_steps
def read_kitti(spark: SparkSession, root: str, split: str = "trainval") -> DataFrame:
    """``(cloud_id, sequence, split, node_id, pos, intensity, y)`` of ``sequences/NN/velodyne/*.bin`` and ``labels/*.label``.

    Splits may be written together; ``pred`` and scans without a label file have y = -1.
    """
    at = r"sequences/(\d+)/\w+/([^/]+)\.\w+$"
    wanted = {n for s in labels.split_names(split, list(labels.KITTI_SEQUENCES)) for n in labels.KITTI_SEQUENCES[s]}

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("sequence", F.regexp_extract("path", at, 1)).withColumn("scan", F.regexp_extract("path", at, 2)).drop("path")
        return df.filter(F.col("sequence").cast("int").isin(sorted(wanted)))

    scans = placed(_lidar(spark, root, 4, 1.0))
    if "pred" in split:
        out = scans.withColumn("y", F.lit(-1).cast("long"))
    else:
        raw = placed(_lidar_labels(spark, root, "*.label", "<u4"))
        out = scans.join(raw, ["sequence", "scan", "node_id"], "left").withColumn("y", labels.remap(F.col("label"), labels.KITTI_LOOKUP, 0xFFFF)).drop("label")
    return out.select(F.xxhash64("sequence", "scan").alias("cloud_id"), "sequence", "scan", labels.sequence_split(F.col("sequence")).alias("split"), "node_id", "pos", "intensity", "y")


@_steps
def read_nuscenes(spark: SparkSession, root: str, manifest: DataFrame, split: str = "trainvaltestpred") -> DataFrame:
    """``(cloud_id, split, node_id, pos, intensity, y)`` of the files in ``manifest(cloud_id, split, lidar_path, label_path)``.

    Paths are relative to ``root``. Five floats a point, the fifth is dropped, intensity over 255; label
    bytes; a null label path gives y = -1. Of the manifest the splits written in ``split`` are read.
    """
    manifest = manifest.filter(F.col("split").isin(labels.split_names(split, ["train", "val", "test", "pred"])))
    below = re.escape(root.rstrip("/").removeprefix("file:")) + "/(.*)$"

    def relative(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.regexp_extract("path", below, 1)).drop("path")

    scans = relative(_lidar(spark, root, 5, 1.0 / 255.0), "lidar_path").join(manifest, "lidar_path")
    raw = relative(_lidar_labels(spark, root, "*_lidarseg.bin", "u1"), "label_path")
    out = scans.join(raw, ["label_path", "node_id"], "left").withColumn("y", labels.remap(F.col("label"), labels.NUSCENES_LOOKUP))
    return out.select("cloud_id", "split", "node_id", "pos", "intensity", "y")


@_steps
def read_rooms(spark: SparkSession, root: str, fold: int = 5) -> DataFrame:
    """``(cloud_id, area, room, split, node_id, pos, color, y)`` of ``Area_i/room/Annotations/label_k.txt``.

    Six numbers a line; lines with missing or NaN values are dropped; colours over 255; the class is the
    label in the file name, unknown ones -1. Nodes are numbered by file, then as in the file.
    """
    names = ["x", "y_", "z", "r", "g", "b"]
    at = r"Area_(\d+)/([^/]+)/Annotations/([^/_]+)_?[^/]*\.txt$"
    raw = spark.read.option("sep", " ").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_*.txt").schema(", ".join(f"{n} double" for n in names)).csv(root)
    raw = raw.withColumn("path", F.col("_metadata.file_path")).withColumn("start", F.col("_metadata.file_block_start")).withColumn("i", F.monotonically_increasing_id())
    for n in names:
        raw = raw.filter(F.col(n).isNotNull() & ~F.isnan(n))
    area, room = F.regexp_extract("path", at, 1).cast("int"), F.regexp_extract("path", at, 2)
    known = {c: i for i, c in enumerate(labels.ROOM_CLASSES)} | {a: labels.ROOM_CLASSES.index(c) for a, c in labels.ROOM_ALIASES.items()}
    y = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.regexp_extract("path", at, 3)), F.lit(-1)).cast("long")
    rows = raw.filter(F.regexp_extract("path", at, 2) != "").select(F.xxhash64(area, room).alias("cloud_id"), area.alias("area"), room.alias("room"), labels.room_split(area, room, fold).alias("split"), "path", "start", "i", F.array(*[F.col(c).cast("float") for c in names[:3]]).alias("pos"), F.array(*[(F.col(c) / 255.0).cast("float") for c in names[3:]]).alias("color"), y.alias("y"))
    return ranked(rows, ["cloud_id"], ["path", "start", "i"], "node_id").drop("path", "start", "i")


@_steps
def read_off(spark: SparkSession, root: str, num_loops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Points and faces of OFF meshes: ``(cloud_id, split, loop, node_id, pos, y)`` and ``(cloud_id, face_id, v)``.

    ``cloud_id`` is the number in the file name; axes are permuted to (z, x, y); y is the vertex number.
    Training meshes are repeated ``num_loops`` times.
    """

    def mesh(content: bytes) -> tuple[np.ndarray, list[list[int]]]:
        words = re.sub(rb"#[^\n]*", b"", content).split()
        if words and words[0].upper() == b"OFF":
            words = words[1:]
        nv, nf = int(words[0]), int(words[1])
        pos = np.array(words[3 : 3 + 3 * nv], np.float64).reshape(-1, 3)
        faces, at = [], 3 + 3 * nv
        for _ in range(nf):
            k = int(words[at])
            faces.append([int(w) for w in words[at + 1 : at + 1 + k]])
            at += 1 + k
        return pos, faces

    def vertices(content: bytes) -> dict:
        pos, _ = mesh(content)
        return {"node_id": np.arange(len(pos)), "pos": _lists(pos[:, [2, 0, 1]])}

    def faces(content: bytes) -> dict:
        _, f = mesh(content)
        return {"node_id": np.arange(len(f)), "v": pa.array(f, pa.list_(pa.int32()))}

    number = F.regexp_extract("path", r"(\d+)\.off$", 1).cast("long")
    points = _decoded(spark, root, "*.off", POINTS, vertices).select(number.alias("cloud_id"), labels.mesh_split(number).alias("split"), "node_id", "pos", F.col("node_id").alias("y"))
    loops = F.explode(F.when(F.col("split") == "train", F.sequence(F.lit(0), F.lit(num_loops - 1))).otherwise(F.array(F.lit(0))))
    f = _decoded(spark, root, "*.off", "path string, node_id long, v array<int>", faces).select(number.alias("cloud_id"), F.col("node_id").alias("face_id"), "v")
    return points.withColumn("loop", loops), f


def hdf5_fields(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of an HDF5 file by name. Needs h5py."""
    import io

    import h5py

    with h5py.File(io.BytesIO(content)) as f:
        return {k: np.asarray(v) for k, v in f.items()}


def object_rows(fields: dict[str, np.ndarray], swap_yz: bool, per_point: str | None) -> dict[str, np.ndarray | pa.Array]:
    """Columns, one row per point, of the arrays ``data (M, P, 3)``, ``label`` and ``per_point (M, P)``."""
    data, label = np.asarray(fields["data"], np.float32), np.asarray(fields["label"]).reshape(len(fields["data"]), -1)[:, 0].astype(np.int64)
    if swap_yz:
        data = data[:, :, [0, 2, 1]]
    m, p = data.shape[:2]
    y = np.asarray(fields[per_point]).reshape(m, -1).astype(np.int64) if per_point else np.repeat(label[:, None], p, 1)
    return {"node_id": np.tile(np.arange(p), m), "pos": _lists(data.reshape(-1, 3)), "item": np.repeat(np.arange(m), p), "y": y.ravel(), "category": np.repeat(label, p)}


@_steps
def read_hdf5_objects(spark: SparkSession, root: str, pattern: str = "*.h5", swap_yz: bool = True, per_point: str | None = None, fields: Callable[[bytes], dict[str, np.ndarray]] = hdf5_fields) -> DataFrame:
    """``(path, node_id, pos, y[, category], cloud_id)`` of files with ``data (M, P, 3)`` and ``label``.

    y is the object's label; with ``per_point`` (the name of a field (M, P)) y is per point and the label
    becomes ``category``. y and z are exchanged unless told otherwise. ``fields`` gives a file's arrays by
    name; for HDF5 it needs h5py on the executors.
    """
    if fields is hdf5_fields:
        try:
            import h5py  # noqa: F401
        except ImportError as e:
            raise ImportError("reading HDF5 needs h5py; export the files to Parquet and use read_parquet_objects") from e
    rows = _decoded(spark, root, pattern, POINTS + ", item long, y long, category long", lambda content: object_rows(fields(content), swap_yz, per_point))
    rows = rows.withColumn("cloud_id", F.xxhash64("path", "item")).drop("item")
    return rows if per_point else rows.drop("category")


@_steps
def read_modelnet40(spark: SparkSession, root: str, split: str = "train", **fields) -> DataFrame:
    """``(cloud_id, split, node_id, pos, y)`` of the files ``ply_data_train*.h5`` or, if ``split`` names no train, ``ply_data_test*.h5``."""
    part = "train" if "train" in split else "test"
    return read_hdf5_objects(spark, root, f"ply_data_{part}*.h5", **fields).select("cloud_id", F.lit(part).alias("split"), "node_id", "pos", "y")


@_steps
def read_modelnet_c(spark: SparkSession, root: str, split: str = "clean", **fields) -> DataFrame:
    """``(cloud_id, split, corruption, level, node_id, pos, y)`` of the file of a corruption split; ``val`` is ``clean``."""
    return _corrupted(spark, root, split, ["y"], **fields)


@_steps
def read_shapenet_c(spark: SparkSession, root: str, split: str = "clean", **fields) -> DataFrame:
    """As ``read_modelnet_c`` with parts: y is the part of each point (``pid``), ``category`` the object's label; axes as they are."""
    return _corrupted(spark, root, split, ["y", "category"], swap_yz=False, per_point="pid", **fields)


def _corrupted(spark: SparkSession, root: str, split: str, kept: list[str], **how) -> DataFrame:
    split = "clean" if split == "val" else split
    if split not in labels.corruption_splits():
        raise ValueError(f"no such split: {split}")
    kind, level = labels.corruption(F.lit(split))
    return read_hdf5_objects(spark, root, f"{split}.h5", **how).select("cloud_id", F.lit(split).alias("split"), kind.alias("corruption"), level.alias("level"), "node_id", "pos", *kept)


@_steps
def read_scanobject(spark: SparkSession, root: str, split: str = "train", variant: str | None = None, background: bool = False, **fields) -> DataFrame:
    """``(cloud_id, split, variant, node_id, pos, y)`` of one variant, with or without the points of the background."""
    if variant not in labels.SCANOBJECT_VARIANTS:
        raise ValueError(f"no such variant: {variant}")
    part = "train" if "train" in split else "test"
    name = ("training" if part == "train" else "test") + "_objectdataset" + labels.SCANOBJECT_FILES[variant] + ".h5"
    rows = read_hdf5_objects(spark, f"{root}/h5_files/main_split{'' if background else '_nobg'}", name, **fields)
    return rows.select("cloud_id", F.lit(part).alias("split"), F.lit(variant).cast("string").alias("variant"), "node_id", "pos", "y")


@_steps
def read_parquet_objects(spark: SparkSession, path: str, swap_yz: bool = True) -> DataFrame:
    """The same from a Parquet export with one row per object: ``(object_id, pos ARRAY<ARRAY<FLOAT>>, y, ...)``."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in ("object_id", "pos")]
    flat = df.select(F.col("object_id").alias("cloud_id"), *rest, F.posexplode("pos").alias("node_id", "p"))
    order = (0, 2, 1) if swap_yz else (0, 1, 2)
    return flat.select("cloud_id", F.col("node_id").cast("long").alias("node_id"), F.array(*[F.get("p", F.lit(i)) for i in order]).alias("pos"), *rest)


def write_points(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("dataset", "split"), mode: str = "errorifexists") -> None:
    """The processed cache: Parquet, partitioned by the columns that are there. Written once unless ``mode`` says so."""
    df.write.mode(mode).partitionBy(*[c for c in partition_by if c in df.columns]).parquet(path)
