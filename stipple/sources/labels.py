"""Label tables and splits of the supported datasets, and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The datasets' published label ids and the classes they are trained on.
KITTI_CLASSES = [
    "car", "bicycle", "motorcycle", "truck", "other-vehicle", "person", "bicyclist", "motorcyclist", "road",
    "parking", "sidewalk", "other-ground", "building", "fence", "vegetation", "trunk", "terrain", "pole", "traffic-sign",
]
# Raw id to class; -1 is unlabelled.
KITTI_LOOKUP = {
    0: -1, 1: -1, 10: 0, 11: 1, 13: 4, 15: 2, 16: 4, 18: 3, 20: 4, 30: 5, 31: 6, 32: 7, 40: 8, 44: 9, 48: 10, 49: 11,
    50: 12, 51: 13, 52: -1, 60: 8, 70: 14, 71: 15, 72: 16, 80: 17, 81: 18, 99: -1, 252: 0, 253: 6, 254: 5, 255: 7,
    256: 4, 257: 4, 258: 3, 259: 4,
}
# Class to the raw id it is written as.
KITTI_ID_WRITTEN = {
    -1: -1, 0: 10, 1: 11, 2: 15, 3: 18, 4: 20, 5: 30, 6: 31, 7: 32, 8: 40, 9: 44, 10: 48, 11: 49, 12: 50, 13: 51,
    14: 70, 15: 71, 16: 72, 17: 80, 18: 81,
}
NUSCENES_LOOKUP = {
    0: -1, 1: -1, 2: 6, 3: 6, 4: 6, 5: -1, 6: 6, 7: -1, 8: -1, 9: 0, 10: -1, 11: -1, 12: 7, 13: -1, 14: 1, 15: 2,
    16: 2, 17: 3, 18: 4, 19: -1, 20: -1, 21: 5, 22: 8, 23: 9, 24: 10, 25: 11, 26: 12, 27: 13, 28: 14, 29: -1, 30: 15,
    31: -1,
}
ROOM_CLASSES = ["ceiling", "floor", "wall", "beam", "column", "window", "door", "chair", "table", "bookcase", "sofa", "board", "clutter"]
ROOM_ALIASES = {"stairs": "clutter"}
ROOM_COLORS = {
    "ceiling": (255, 255, 153), "floor": (177, 89, 40), "wall": (178, 223, 138), "beam": (255, 127, 0),
    "column": (253, 191, 111), "window": (166, 206, 227), "door": (31, 120, 180), "chair": (251, 154, 153),
    "table": (106, 61, 154), "bookcase": (202, 178, 214), "sofa": (227, 26, 28), "board": (51, 160, 44), "clutter": (44, 44, 44),
}
ROOM_VALIDATION = [
    "hallway_1", "hallway_6", "hallway_11", "office_1", "office_6", "office_11", "office_16", "office_21", "office_26",
    "office_31", "office_36", "WC_2", "storage_1", "storage_5", "conferenceRoom_2", "auditorium_1",
]
SCANOBJECT_CLASSES = ["bag", "bed", "bin", "box", "cabinets", "chair", "desk", "display", "door", "pillow", "shelves", "sink", "sofa", "table", "toilet"]
SCANOBJECT_VARIANTS = [None, "PB_T25", "PB_T25_R", "PB_T50_R", "PB_T50_RS"]
# What the file names of the variants end with.
SCANOBJECT_FILES = {None: "", "PB_T25": "_augmented25_norot", "PB_T25_R": "_augmented25rot", "PB_T50_R": "_augmentedrot", "PB_T50_RS": "_augmentedrot_scale75"}
CORRUPTIONS = ["scale", "jitter", "rotate", "dropout_global", "dropout_local", "add_global", "add_local"]
KITTI_SEQUENCES = {"train": [0, 1, 2, 3, 4, 5, 6, 7, 9, 10], "val": [8], "test": [8], "pred": list(range(11, 22))}


def corruption_splits() -> list[str]:
    """``clean`` and five levels of each corruption."""
    return ["clean", *(f"{c}_{level}" for c in CORRUPTIONS for level in range(5))]


def split_names(split: str, known: list[str]) -> list[str]:
    """The splits a name stands for: itself, or several written together (``trainval``)."""
    return [s for s in known if s in split]


def remap(label: Column, lookup: dict[int, int], mask: int | None = None, default: int = -1) -> Column:
    """The class of a raw label id: low bits under ``mask``, looked up; unknown ids and nulls give ``default``."""
    key = label.cast("long")
    if mask is not None:
        key = key.bitwiseAND(F.lit(mask))
    table = F.create_map(*[F.lit(int(x)) for kv in lookup.items() for x in kv])
    return F.coalesce(F.element_at(table, key.cast("int")), F.lit(default)).cast("long")


def remap_join(df: DataFrame, label: str, lookup: DataFrame, default: int = -1) -> DataFrame:
    """The same by a join with a table ``(id, y)`` of a fixed size, broadcast."""
    return df.join(F.broadcast(lookup.withColumnRenamed("id", label)), label, "left").withColumn("y", F.coalesce("y", F.lit(default)))


def label_table(spark: SparkSession, lookup: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(lookup.items()), "id int, y int")


def class_table(spark: SparkSession) -> DataFrame:
    """``(dataset, y, name, written, color)``: the named classes, the raw id a class is written as, and its colour (of 255), where there is one."""
    rows = [("SemanticKITTI", i, n, KITTI_ID_WRITTEN[i], None) for i, n in enumerate(KITTI_CLASSES)]
    rows += [("S3DIS", i, n, None, list(ROOM_COLORS[n])) for i, n in enumerate(ROOM_CLASSES)]
    rows += [("ScanObjectNN", i, n, None, None) for i, n in enumerate(SCANOBJECT_CLASSES)]
    return spark.createDataFrame(rows, "dataset string, y long, name string, written int, color array<int>")


def room_split(area: Column, room: Column, fold: int = 5) -> Column:
    """Area folds: the fold's area is test, named rooms of other areas are val, the rest train; fold 0 means area 6."""
    test = 6 if fold == 0 else fold
    return F.when(area == test, "test").when(room.isin(ROOM_VALIDATION), "val").otherwise("train")


def sequence_split(sequence: Column) -> Column:
    """The split of a drive by its number; drives in no split give null."""
    n = sequence.cast("int")
    return F.when(n.isin(KITTI_SEQUENCES["train"]), "train").when(n.isin(KITTI_SEQUENCES["val"]), "val").when(n.isin(KITTI_SEQUENCES["pred"]), "pred")


def mesh_split(number: Column, train: int = 79) -> Column:
    """Registered meshes by file number: the first 79 train, the rest test."""
    return F.when(number < train, "train").otherwise("test")


def corruption(split: Column) -> tuple[Column, Column]:
    """Kind and level of a corruption split; ``clean`` (and its alias ``val``) is ``clean`` at level null, others null."""
    at = r"^(" + "|".join(CORRUPTIONS) + r")_([0-4])$"
    kind = F.when(split.isin("clean", "val"), "clean").when(split.rlike(at), F.regexp_extract(split, at, 1))
    return kind, F.when(split.rlike(at), F.regexp_extract(split, at, 2)).cast("int")
