"""Log statistics, integrity and compaction.

A log row has key, value, tombstone, seg and seq (the order of writing).
"""

from __future__ import annotations

import zlib
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a record besides key and value.
HEADER = 21


def record_size(key: str = "key", value: str = "value") -> Column:
    return (F.lit(HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def intact(rows: DataFrame, bad: Column, seg: str = "seg", seq: str = "seq") -> DataFrame:
    """Rows before the first bad one of their segment; other segments stay whole."""
    first = rows.where(bad).groupBy(seg).agg(F.min(seq).alias("_bad"))
    return rows.join(first, seg, "left").where(F.col("_bad").isNull() | (F.col(seq) < F.col("_bad"))).drop("_bad")


def with_dead(rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """rows with `last` (the key's last record) and `dead` (overwritten, or a tombstone)."""
    ends = rows.groupBy(key).agg(F.max(seq).alias("_end"))
    last = F.col(seq) == F.col("_end")
    return rows.join(ends, key).withColumns({"last": last, "dead": ~last | F.col("tombstone")}).drop("_end")


def segment_stats(rows: DataFrame) -> DataFrame:
    """seg, records, bytes, dead_bytes."""
    size = record_size()
    return with_dead(rows).groupBy("seg").agg(
        F.count("*").alias("records"), F.sum(size).alias("bytes"), F.coalesce(F.sum(F.when(F.col("dead"), size)), F.lit(0)).cast("long").alias("dead_bytes")
    )


def compaction_candidates(rows: DataFrame, ratio: float = 0.5, capacity: int = 0) -> DataFrame:
    """Segments whose share of dead bytes is ratio or more, of the bytes that a segment
    may hold or, with no capacity given, of those it holds; not the last, still open."""
    stats = segment_stats(rows)
    last = rows.agg(F.max("seg").alias("_open"))
    share = F.col("dead_bytes").cast("double") / (F.lit(capacity) if capacity else F.col("bytes")).cast("double")
    return stats.join(F.broadcast(last), F.col("seg") < F.col("_open")).where(share >= ratio).drop("_open")


def compacted(rows: DataFrame, ratio: float = 0.5, capacity: int = 0) -> DataFrame:
    """The log with its candidates rewritten: only each key's last record stays in
    them, tombstones included, as an older record may live on in another segment."""
    chosen = compaction_candidates(rows, ratio, capacity).select("seg", F.lit(True).alias("_chosen"))
    marked = with_dead(rows).join(chosen, "seg", "left")
    return marked.where(F.col("_chosen").isNull() | F.col("last")).select(*rows.columns)


def store_stats(rows: DataFrame) -> DataFrame:
    """One row: keys, segments, dead_bytes."""
    marked = with_dead(rows)
    return marked.agg(
        F.coalesce(F.sum((F.col("last") & ~F.col("tombstone")).cast("long")), F.lit(0)).alias("keys"),
        F.count_distinct("seg").alias("segments"),
        F.coalesce(F.sum(F.when(F.col("dead"), record_size())), F.lit(0)).alias("dead_bytes"),
    )


def record_crc() -> Column:
    """CRC-32 (IEEE) of a record: its lengths, tombstone, time and order, then key and
    value.  A value of null counts as empty; the tombstone tells them apart."""
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    head = F.concat_ws(":", F.octet_length("key"), F.octet_length(value), F.col("tombstone").cast("int"), "ts_ns", "seq", F.lit(""))
    return F.crc32(F.concat(head.cast("binary"), F.col("key").cast("binary"), value))


def crc_of(key: bytes, value: bytes | None, ts_ns: int, seq: int) -> int:
    """The same for one record; no value means a tombstone."""
    own = value or b""
    return zlib.crc32(f"{len(key)}:{len(own)}:{int(value is None)}:{ts_ns}:{seq}:".encode() + key + own)


def sound() -> Column:
    """Whether a record is as its stored checksum (`crc`) says; none means no."""
    return F.coalesce(record_crc() == F.col("crc"), F.lit(False))


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at a false positive rate."""
    bits = max(ceil(-n * log(rate) / log(2) ** 2), 8)
    return bits, max(round(bits / max(n, 1) * log(2)), 1)


def bloom_sizing(rows: DataFrame, key: str, rate: float) -> DataFrame:
    bits = F.greatest(F.ceil(-F.col("n") * F.lit(log(rate)) / F.lit(log(2) ** 2)), F.lit(8)).cast("long")
    return rows.agg(F.count_distinct(key).alias("n")).select("n", bits.alias("bits"))
