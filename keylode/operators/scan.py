"""Lookups, existence, prefix and ordered scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylode.errors import MAX_KEY


def successor(prefix: bytes) -> bytes | None:
    """The least byte string after all that begin with prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def has_prefix(column: str, prefix: bytes | str, kind: T.DataType) -> Column:
    """A prefix test that reaches the Parquet scan for strings and binaries alike."""
    if not prefix:
        return F.lit(True)
    if isinstance(kind, T.BinaryType):
        raw = prefix.encode() if isinstance(prefix, str) else prefix
        test = F.col(column) >= F.lit(raw)
        after = successor(raw)
        return test if after is None else test & (F.col(column) < F.lit(after))
    return F.col(column).startswith(prefix.decode() if isinstance(prefix, bytes) else prefix)


def key_fault(key: str) -> Column:
    """Why a key can't be stored: 'empty' (null too) or 'too large', counted in bytes;
    null for a good one."""
    size = F.octet_length(F.col(key))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MAX_KEY, "too large")


def valid_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(key_fault(key).isNull())


def refused_keys(rows: DataFrame, key: str, name: str = "fault") -> DataFrame:
    """The rows that valid_keys leaves out, with the reason."""
    return rows.withColumn(name, key_fault(key)).where(F.col(name).isNotNull())


def get(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def multi_get(table: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    return table.join(probes.select(key), key, "left_semi")


def has(table: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """probes with `found`."""
    known = table.select(key).join(probes.select(key), key, "left_semi").distinct().withColumn("found", F.lit(True))
    return probes.join(known, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def absent(table: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    return probes.join(table.select(key), key, "left_anti")


def hidden(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the keys that a session has deleted."""
    return table.join(keys.select(key), key, "left_anti")


def scan(table: DataFrame, key: str, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> DataFrame:
    """Iteration: a prefix, and an order if asked for; reverse alone means nothing."""
    rows = table.where(has_prefix(key, prefix, table.schema[key].dataType))
    return rows.orderBy(F.col(key).desc() if reverse else F.col(key).asc()) if ordered else rows


def filter_all(table: DataFrame, keep: Column | Callable[[str], Column], line: str = "line") -> DataFrame:
    return table.where(keep if isinstance(keep, Column) else keep(line))


#: Rows that are sampled for each range of `positions`.
PER_RANGE = 64


def _range_of(rows: DataFrame, key: str) -> Callable[[str], Column]:
    """The number of a value's range, for ranges cut by a bounded sample of keys."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the least hashes are the same keys in each run; nulls cut nothing
    picked = sorted(r[0] for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(PER_RANGE * parts).collect())
    cuts = list(dict.fromkeys(picked[PER_RANGE::PER_RANGE]))
    if not cuts:
        return lambda c: F.lit(0)
    return lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col(c)))


def positions(rows: DataFrame, key: str, name: str = "pos", reverse: bool = False) -> DataFrame:
    """rows with their place (from 1) in the order of a unique, non-null key.

    Ranges come from a bounded sample of keys; places are numbered within each range
    and moved by the sizes of the ranges before it, so no task sorts all rows and the
    result doesn't depend on the sample.
    """
    ranged = rows.withColumn("_range", _range_of(rows, key)(key))
    direction = F.col(key).desc() if reverse else F.col(key).asc()
    within = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(direction)))
    # a row for each range: one more than cuts at most
    before = Window.orderBy(F.col("_range").desc() if reverse else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(sizes), "_range").select(*rows.columns, (F.col("_before") + F.col("_at")).cast("long").alias(name))


def sparse_sample(rows: DataFrame, key: str, every: int) -> DataFrame:
    """Every n-th key in order, the first included."""
    return positions(rows, key).where((F.col("pos") - 1) % every == 0)


def floor_keys(probes: DataFrame, keys: DataFrame, probe: str, key: str) -> DataFrame:
    """probes with the greatest key not above each (`floor`): null if there is none, or
    the probe is null.  Keys and probes are of one orderable type, bytes included.

    Keys and distinct probes are dealt to ranges cut by a bounded sample of keys; each
    range takes a running maximum, and what earlier ranges hold is one row a range.
    """
    place = _range_of(keys, key)
    asked = probes.select(F.col(probe).alias("_at"), F.lit(None).alias("_key")).where("_at is not null").distinct()
    held = keys.select(F.col(key).alias("_at"), F.col(key).alias("_key")).where("_at is not null")
    both = held.unionByName(asked).withColumn("_range", place("_at"))
    upto = Window.partitionBy("_range").orderBy("_at", F.col("_key").asc_nulls_last())
    near = both.withColumn("_near", F.max("_key").over(upto)).where(F.col("_key").isNull())
    # a row for each range: one more than cuts at most
    tops = both.groupBy("_range").agg(F.max("_key").alias("_top"))
    earlier = tops.select("_range", F.max("_top").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    floors = near.join(F.broadcast(earlier), "_range").select(F.col("_at").alias(probe), F.coalesce("_near", "_earlier").alias("floor"))
    return probes.join(floors, probe, "left").select(*probes.columns, "floor")
