"""Operators on attributes (columns)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.functions import rng
from stipple.operators.model import with_set_stats


def identity(df: DataFrame) -> DataFrame:
    return df


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One operator that applies the given ones in order."""
    return lambda df: reduce(lambda d, f: f(d), steps, df)


def discard_attributes(df: DataFrame, *names: str) -> DataFrame:
    """Without the named columns; names that are not there are ignored. Node identity columns stay unless named."""
    return df.drop(*names)


def _as_array(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name).cast("array<double>")
    return F.array(F.col(name).cast("double"))


def attribute_as_feature(df: DataFrame, attributes: Sequence[str], overwrite: bool = True, drop: bool = True) -> DataFrame:
    """``x`` = the attributes' values one after another, in the given order; appended to ``x`` unless ``overwrite``."""
    cols = [_as_array(df, a) for a in attributes]
    if not overwrite and "x" in df.columns:
        cols.insert(0, _as_array(df, "x"))
    out = df.withColumn("x", F.concat(*cols))
    return out.drop(*[a for a in attributes if a != "x"]) if drop else out


def _scaled(df: DataFrame, name: str, factor: Column) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.transform(name, lambda v: v.cast("double") * factor)
    return F.col(name).cast("double") * factor


def scale_attribute(df: DataFrame, attribute: str, factor: float, p: float = 1.0, seed: int = 0) -> DataFrame:
    """The attribute times ``factor``, for each set with probability ``p``."""
    f = F.lit(float(factor))
    if p < 1.0:
        f = F.when(rng.bernoulli(p, seed, "scale", "cloud_id"), f).otherwise(F.lit(1.0))
    return df.withColumn(attribute, _scaled(df, attribute, f))


def attribute_dropout(df: DataFrame, attribute: str, p: float = 0.2, seed: int = 0) -> DataFrame:
    """The attribute set to zero, for each whole set with probability ``p``."""
    f = F.when(rng.bernoulli(p, seed, "dropout", "cloud_id"), F.lit(0.0)).otherwise(F.lit(1.0))
    return df.withColumn(attribute, _scaled(df, attribute, f))


def extract_heights(df: DataFrame, gravity_axis: int = 2, ground: bool = False) -> DataFrame:
    """``height`` = the position along the gravity axis, above its set's lowest point if ``ground``."""
    h = F.get("pos", F.lit(gravity_axis)).cast("double")
    if not ground:
        return df.withColumn("height", h)
    return with_set_stats(df, [F.min(h).alias("__low")]).withColumn("height", h - F.col("__low")).drop("__low")
