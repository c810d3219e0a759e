"""Samples of a fixed size that are the same in every run."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.session import cut_lineage

# Leading hexadecimal digits of a draw that are compared with the limit.
DIGITS = 13


def draw(key: Sequence[str], seed: str = "") -> Column:
    """The place of a row in a random order that depends on its key and the seed only. Null counts as empty."""
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)))


def bottom_k(df: DataFrame, key: Sequence[str], k: int, seed: str = "") -> DataFrame:
    """The ``k`` rows with the smallest draws, all rows if there are no more; rows of one key by their values.

    A row is in the sample whatever partition or table part it is in, so samples of parts can be merged: the
    sample of their union is the sample of the whole. Rows above a limit that slightly more than ``k`` draws are
    expected to stay below are left out before the sort, so a task that merges gets about ``k`` rows and not ``k``
    of every partition; if fewer are found (keys that many rows share), the limit is raised and the rows are read again.
    """
    if k < 0:
        raise ValueError("the size of a sample cannot be negative")
    rows = df.count()
    if rows <= k:
        return df
    name = "_draw"
    while name in df.columns:
        name += "_"
    drawn = df.withColumn(name, draw(key, seed))
    wanted = k + 10 * math.sqrt(k) + 50
    while True:
        limit = int(wanted / rows * 16**DIGITS)
        below = drawn.where(F.col(name) < f"{limit:0{DIGITS}x}") if limit < 16**DIGITS else drawn
        found = cut_lineage(below.orderBy(name, *df.columns).limit(k))
        if limit >= 16**DIGITS or found.count() == k:
            return found.drop(name)
        wanted *= 16
