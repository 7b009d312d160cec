"""Applying a selection: gathering rows, renumbering nodes, remapping edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes that refer to nodes by position and so lose their meaning when nodes are selected.
STALE = ("cluster", "index")


def apply_selection(points: DataFrame, selection: DataFrame | None, strict: bool = False) -> DataFrame:
    """The selected rows with ``node_id`` = their position in the selection; a node selected twice comes twice.

    Columns whose names contain ``cluster`` or ``index`` are dropped. Without a selection the points pass
    as they are. ``strict`` raises if nothing is selected.
    """
    if selection is None:
        return points
    if strict and not selection.limit(1).count():
        raise ValueError("nothing is selected")
    kept = [c for c in points.columns if c not in ("cloud_id", "node_id") and not any(s in c for s in STALE)]
    chosen = selection.select("cloud_id", "node_id", "sel_pos")
    return points.join(chosen, ["cloud_id", "node_id"]).select("cloud_id", F.col("sel_pos").alias("node_id"), *kept)


def apply_mask(points: DataFrame, mask: str) -> DataFrame:
    """A boolean column as a selection: rows where it is true, in node order."""
    from stipple.functions.ranks import id_bucket, ranked

    ids = points.filter(F.col(mask)).select("cloud_id", "node_id")
    return ranked(ids, ["cloud_id"], ["node_id"], "sel_pos", id_bucket("node_id")).select("cloud_id", "node_id", "sel_pos")


def select_edges(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """Edges ``(cloud_id, dst, rank, src)`` of the selected nodes in their new numbers.

    An edge from a node that was not selected becomes one from the node to itself. Selections with
    repeated nodes have no unique numbers and raise nothing here: pass distinct ones.
    """
    to = selection.select("cloud_id", F.col("node_id").alias("dst"), F.col("sel_pos").alias("new_dst"))
    fro = selection.select("cloud_id", F.col("node_id").alias("src"), F.col("sel_pos").alias("new_src"))
    kept = edges.join(to, ["cloud_id", "dst"]).join(fro, ["cloud_id", "src"], "left")
    return kept.select("cloud_id", F.col("new_dst").alias("dst"), "rank", F.coalesce("new_src", "new_dst").alias("src"))
