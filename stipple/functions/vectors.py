"""Arithmetic on short vectors held in array columns, unrolled into plain columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(col: str | Column, dims: int) -> list[Column]:
    """The first ``dims`` elements as doubles."""
    c = F.col(col) if isinstance(col, str) else col
    return [F.get(c, F.lit(d)).cast("double") for d in range(dims)]


def vector(values: Sequence[Column]) -> Column:
    return F.array(*values)


def affine(v: Sequence[Column], m: Sequence[Sequence[Column | float]]) -> list[Column]:
    """``m @ v``: each output is the dot product of a row of ``m`` with ``v``."""
    out = []
    for row in m:
        total = None
        for a, x in zip(row, v, strict=True):
            term = (a if isinstance(a, Column) else F.lit(float(a))) * x
            total = term if total is None else total + term
        out.append(total)
    return out


def norm(v: Sequence[Column]) -> Column:
    total = v[0] * v[0]
    for x in v[1:]:
        total = total + x * x
    return F.sqrt(total)


def permute(col: str, order: Sequence[int]) -> Column:
    """The elements of an array in another order (axis permutation on ingest)."""
    return F.array(*[F.get(F.col(col), F.lit(i)) for i in order])
