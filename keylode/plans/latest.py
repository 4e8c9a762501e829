"""Last write wins: the row of the greatest order for each key.

Each reduction is one aggregation with a partial step before the shuffle, so a hot key
moves one row for each task.  The order must be unique within a key and not null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str] | None = None, tombstone: Column | None = None) -> DataFrame:
    """The last row of each key; keys whose last row is a tombstone are left out."""
    values = [c for c in rows.columns if c != key] if values is None else list(values)
    picked = list(dict.fromkeys([*values, *order]))
    dead = F.lit(False) if tombstone is None else F.coalesce(tombstone, F.lit(False))
    row = F.struct(*picked, dead.alias("_dead"))
    best = rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.where(~F.col("_row._dead")).select(key, *(f"_row.{c}" for c in values))


def merged(sources: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Sources in precedence order (file_idx), later wins; within one, larger offset."""
    return latest(reduce(DataFrame.unionByName, sources), key, order)


def refreshed(existing: DataFrame, added: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """An already reduced table and new rows of later sources: no old source is read."""
    return latest(existing.unionByName(added), key, order)


def replayed(checkpoint: DataFrame, tail: DataFrame, key: str, order: Sequence[str], tombstone: Column) -> DataFrame:
    """A checkpoint of live rows, and the log after its watermark."""
    return latest(checkpoint.unionByName(tail), key, order, tombstone=tombstone)
