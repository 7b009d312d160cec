"""Random numbers that depend on a row's key only, so they do not change with partitioning or engine.

``uniform(seed, tag, *keys)`` is the first 32 bits of the MD5 of ``seed:tag:key:...`` over 2**32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """Uniform in [0, 1)."""
    parts = [F.lit(f"{seed}:{tag}"), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def open_uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1): never 0, for logarithms."""
    return uniform(seed, tag, *keys) + F.lit(0.5 / 4294967296.0)


def between(low: float, high: float, seed: int, tag: str, *keys: Column | str) -> Column:
    return F.lit(float(low)) + uniform(seed, tag, *keys) * F.lit(float(high) - float(low))


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    """Standard normal by Box-Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(open_uniform(seed, tag + "a", *keys))) * F.cos(F.lit(2.0 * math.pi) * uniform(seed, tag + "b", *keys))


def bernoulli(p: float, seed: int, tag: str, *keys: Column | str) -> Column:
    return uniform(seed, tag, *keys) < F.lit(float(p))


def uniform_sql(seed: int, tag: str, *keys: str) -> str:
    """The same number as DuckDB SQL."""
    parts = ", ".join(f"coalesce(({k})::varchar, '')" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}:{tag}'{', ' + parts if parts else ''})), 1, 8))::bigint::double / 4294967296.0::double)"
