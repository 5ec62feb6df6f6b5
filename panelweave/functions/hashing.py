"""Uniform draws that depend only on their keys.

A draw is a hash of (seed, keys, slot), so results do not change with partitioning, task
retries or executor loss, and any engine with md5 can recompute them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """A double in (0, 1): the first 32 bits of md5('seed|key|…'), centred in its bin."""
    parts = [F.lit(str(seed))]
    for key in keys:
        column = F.lit(str(key)) if isinstance(key, int) else (F.col(key) if isinstance(key, str) else key)
        parts.append(column.cast("string"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def normal(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms (Box and Muller 1958)."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
