"""Stores of single records on top of tables: a log, and a line file.

Writes are buffered on the driver and appended as one batch by sync(), a read or
close(); a read so sees every earlier write.  Iteration is a DataFrame, a snapshot:
later writes don't show in it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylode.errors import Closed, Corrupt, EmptyKey, InvalidLine, NoLineKey, NotFound, checked_key
from keylode.files import Files
from keylode.functions.keys import JsonCodec, JsonLineCodec
from keylode.operators import log, scan
from keylode.plans.latest import latest, replayed
from keylode.sources import lines

LOG = T.StructType().add("key", "binary").add("value", "binary").add("tombstone", "boolean").add("ts_ns", "long").add("seg", "integer").add("seq", "long").add("crc", "long")
LIVE = T.StructType().add("key", "binary").add("value", "binary").add("ts_ns", "long").add("seg", "integer").add("seq", "long")


class Reader(Protocol):
    def get(self, key: bytes | str) -> bytes: ...
    def has(self, key: bytes | str) -> bool: ...


class Store(Reader, Protocol):
    def put(self, key: bytes | str, value: bytes) -> None: ...
    def delete(self, key: bytes | str) -> None: ...
    def scan(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> DataFrame: ...
    def decoded(self, raw: Column) -> Column: ...


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


@dataclass(frozen=True)
class Options:
    """Defaults stand in for values of 0 or less; a ratio over 1 is refused.

    sync_on_write: each put and delete is a batch of its own.  snapshot: close() writes
    the live records, so that the next open replays only what was logged after them."""

    segment_bytes: int = 0
    dead_ratio: float = 0.0
    sync_on_write: bool = False
    snapshot: bool = True

    def checked(self) -> Options:
        if self.dead_ratio > 1:
            raise ValueError("dead_ratio is over 1")
        return replace(self, segment_bytes=self.segment_bytes if self.segment_bytes > 0 else 64 << 20, dead_ratio=self.dead_ratio if self.dead_ratio > 0 else 0.5)


@dataclass
class _State:
    """What a log store's state file says.  A part is [folder, first and last segment,
    last order]; snapshot is [folder, order up to which it holds], or nothing; old names
    folders that the last change replaced."""

    parts: list[list] = field(default_factory=list)
    seq: int = 0
    seg: int = 0
    fill: int = 0
    snapshot: list = field(default_factory=list)
    old: list[str] = field(default_factory=list)


class LogStore:
    """Key to bytes: an append-only log of puts and tombstones, last write wins.

    A batch is a folder that the state file names once it is whole; a crash before that
    leaves the state as it was.  Opening checks the checksums of what no snapshot holds:
    a record that doesn't match ends its segment there, others stay whole.  A snapshot
    that is missing, or newer than the log, isn't used: the whole log is.  Folders that
    a change replaces stay until the next change, for those who still read them.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.options = options.checked()
        self.spark, self.path, self.files = spark, path, Files(spark)
        self._buffer: list[tuple] = []
        self._open = True
        self._read_state()
        self._recover()

    def _read_state(self) -> None:
        name = f"{self.path}/state.json"
        try:
            self._state = _State(**self.files.read_json(name)) if self.files.exists(name) else _State()
        except (ValueError, TypeError) as e:
            raise Corrupt(name) from e
        s = self._state
        if s.snapshot and (s.snapshot[1] > s.seq or not self.files.exists(f"{self.path}/{s.snapshot[0]}/_SUCCESS")):
            s.snapshot = []

    def _save(self) -> None:
        self.files.put(f"{self.path}/state.json", json.dumps(asdict(self._state)).encode())

    def _replace(self, gone: list[str]) -> None:
        """Name the new state; what the change before this one replaced goes now."""
        before, self._state.old = self._state.old, gone
        self._save()
        for name in before:
            self.files.delete(f"{self.path}/{name}")

    def _read(self, parts: list[list]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/{p[0]}" for p in parts))

    def _write(self, rows: DataFrame) -> list[list]:
        """rows as a part; none if there are none."""
        name = f"log-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        held = self._read([[name]]).agg(F.min("seg"), F.max("seg"), F.max("seq")).first()
        return [] if held[0] is None else [[name, *held]]

    def _tail(self) -> list[list]:
        """The parts that hold more than the snapshot."""
        s = self._state
        return [p for p in s.parts if not s.snapshot or p[3] > s.snapshot[1]]

    def _recover(self) -> None:
        tail = self._tail()
        if not tail or not self._read(tail).where(~log.sound()).limit(1).collect():
            return
        # the segments that are cut may begin in parts before: only their tail is checked
        s, kept = self._state, self._write(log.intact(self._read(tail), ~log.sound()).select(LOG.names))
        s.parts = [p for p in s.parts if p not in tail] + kept
        s.seg, s.fill = s.seg + 1, 0
        self._replace([p[0] for p in tail])

    def _check(self) -> None:
        if not self._open:
            raise Closed(self.path)

    def _append(self, key: bytes, value: bytes | None) -> None:
        size = log.HEADER + len(key) + len(value or b"")
        if size > self.options.segment_bytes:
            raise ValueError("the record is larger than a segment")
        s, now = self._state, time.time_ns()
        if s.fill + size > self.options.segment_bytes:
            s.seg, s.fill = s.seg + 1, 0
        s.fill += size
        s.seq += 1
        self._buffer.append((bytearray(key), None if value is None else bytearray(value), value is None, now, s.seg, s.seq, log.crc_of(key, value, now, s.seq)))
        if self.options.sync_on_write:
            self.sync()

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self._check()
        self._append(checked_key(key), _bytes(value))

    def delete(self, key: bytes | str) -> None:
        self._check()
        self._append(checked_key(key), None)

    def sync(self) -> None:
        """Write the buffered records as one batch, then name it in the state."""
        self._check()
        if self._buffer:
            part = f"log-{uuid.uuid4().hex}"
            self.spark.createDataFrame(self._buffer, LOG).write.parquet(f"{self.path}/{part}")
            self._state.parts.append([part, self._buffer[0][4], self._buffer[-1][4], self._buffer[-1][5]])
            self._buffer = []
            self._save()

    def log(self) -> DataFrame:
        """All records that weren't compacted away."""
        self.sync()
        return self._read(self._state.parts)

    def replay(self, keep: Column | None = None) -> DataFrame:
        """The live records: of the snapshot and the log after it, or of the whole log.
        keep chooses keys and reaches the scans."""
        self.sync()
        s, keep = self._state, F.lit(True) if keep is None else keep
        tail = self._read(self._tail()).where(keep).select(*LIVE.names, "tombstone")
        if not s.snapshot:
            return latest(tail, "key", ["seq"], LIVE.names[1:], F.col("tombstone"))
        held = self.spark.read.schema(LIVE).parquet(f"{self.path}/{s.snapshot[0]}").where(keep).withColumn("tombstone", F.lit(False))
        return replayed(held, tail.where(F.col("seq") > s.snapshot[1]), "key", ["seq"], F.col("tombstone")).select(LIVE.names)

    def latest(self) -> DataFrame:
        return self.replay()

    def snapshot(self) -> None:
        """Write the live records, unless nothing was logged since the last snapshot."""
        self.sync()
        s = self._state
        if not s.parts or s.snapshot and s.snapshot[1] == s.seq:
            return
        name, gone = f"snap-{uuid.uuid4().hex}", s.snapshot[:1]
        self.replay().write.parquet(f"{self.path}/{name}")
        s.snapshot = [name, s.seq]
        self._replace(gone)

    def get(self, key: bytes | str) -> bytes:
        self._check()
        own = checked_key(key)
        # only the key's records are reduced: the filter reaches the scan
        found = self.replay(F.col("key") == F.lit(own)).select("value").collect()
        if not found:
            raise NotFound(key)
        return bytes(found[0]["value"])

    def has(self, key: bytes | str) -> bool:
        self._check()
        own = checked_key(key)
        return bool(self.replay(F.col("key") == F.lit(own)).select("key").limit(1).collect())

    def scan(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> DataFrame:
        self._check()
        rows = self.replay(scan.has_prefix("key", _bytes(prefix), T.BinaryType()))
        return scan.scan(rows.select("key", "value"), "key", b"", ordered, reverse)

    def all(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> Iterator[tuple[bytes, bytes]]:
        return ((bytes(r["key"]), bytes(r["value"])) for r in self.scan(prefix, ordered, reverse).toLocalIterator())

    def decoded(self, raw: Column) -> Column:
        return raw

    def stats(self) -> dict:
        self._check()
        return log.store_stats(self.log()).first().asDict()

    def compact(self) -> int:
        """Rewrite the parts that hold segments which are dead enough, without overwritten
        records of those; other parts aren't written again.  The number of such parts."""
        self._check()
        rows, s = self.log(), self._state
        if not s.parts:
            return 0
        chosen = log.compaction_candidates(rows, self.options.dead_ratio, self.options.segment_bytes).select("seg").persist()
        try:
            # names that the state lists anyway
            place = F.regexp_extract(F.col("_metadata.file_path"), "/(log-[0-9a-f]+)/[^/]*$", 1)
            names = {r[0] for r in rows.select("seg", place.alias("part")).join(chosen, "seg", "left_semi").select("part").distinct().collect()}
            touched = [p for p in s.parts if p[0] in names]
            if touched:
                held, ends = self._read(touched), rows.groupBy("key").agg(F.max("seq").alias("seq"))
                last = held.join(chosen, "seg", "left_semi").join(ends, ["key", "seq"], "left_semi").select(LOG.names)
                kept = self._write(held.join(chosen, "seg", "left_anti").select(LOG.names).unionByName(last))
                s.parts = [p for p in s.parts if p[0] not in names] + kept
                self._replace([p[0] for p in touched])
            return len(touched)
        finally:
            chosen.unpersist()

    def close(self) -> None:
        if self._open:
            self.sync()
            if self.options.snapshot:
                self.snapshot()
            self._open = False


class LineStore:
    """A plain line file, keyed by a key function; the last line of a key counts.

    `key` works on Columns, `key_of` on the bytes of one line, for puts.  delete() hides
    a key in this session only: the file keeps its lines."""

    def __init__(self, spark: SparkSession, path: str, key: Callable[[Column], Column], key_of: Callable[[bytes], bytes | None]):
        self.spark, self.path, self.key, self.key_of, self.files = spark, path, key, key_of, Files(spark)
        self._hidden: set[bytes] = set()
        self._buffer: list[bytes] = []
        self._open = True
        if not self.files.exists(path):
            self.files.put(path, b"")

    def _check(self) -> None:
        if not self._open:
            raise Closed(self.path)

    def put(self, line: bytes | str) -> None:
        self._check()
        line = _bytes(line)
        key = self.key_of(line)
        if not key:
            raise NoLineKey(line[:80])
        if b"\n" in line:
            raise InvalidLine(line[:80])
        self._buffer.append(line)
        self._hidden.discard(key)

    def delete(self, key: bytes | str) -> None:
        self._check()
        self._hidden.add(checked_key(key))

    def sync(self) -> None:
        """Append the buffered lines; a last line without its end is ended first."""
        self._check()
        if self._buffer:
            seal = b"\n" if self.files.last_byte(self.path) not in (b"", b"\n") else b""
            self.files.append(self.path, seal + b"".join(x + b"\n" for x in self._buffer))
            self._buffer = []

    def table(self) -> DataFrame:
        self.sync()
        rows = latest(lines.keyed(lines.lines(self.spark, self.path), self.key), "key", ["file_idx", "src_off"])
        if not self._hidden:
            return rows
        return scan.hidden(rows, self.spark.createDataFrame([(bytearray(k),) for k in self._hidden], "key binary"), "key")

    def get(self, key: bytes | str) -> bytes:
        self._check()
        found = self.table().where(F.col("key") == F.lit(checked_key(key))).select("line").collect()
        if not found:
            raise NotFound(key)
        return bytes(found[0][0])

    def has(self, key: bytes | str) -> bool:
        self._check()
        return bool(self.table().where(F.col("key") == F.lit(checked_key(key))).limit(1).collect())

    def scan(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> DataFrame:
        self._check()
        return scan.scan(self.table(), "key", _bytes(prefix), ordered, reverse)

    def all(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> Iterator[tuple[bytes, bytes]]:
        return ((bytes(r["key"]), bytes(r["line"])) for r in self.scan(prefix, ordered, reverse).toLocalIterator())

    def __len__(self) -> int:
        return self.table().count()

    def close(self) -> None:
        if self._open:
            self.sync()
            self._open = False


class LineFileStore:
    """A LineStore as a store of keys and values: a codec builds and reads the lines."""

    def __init__(self, lines_: LineStore, codec: JsonLineCodec = JsonLineCodec()):
        self.inner, self.codec = lines_, codec

    def put(self, key: bytes | str, value: bytes | str) -> None:
        own = checked_key(key)
        line = self.codec.build_line(own, _bytes(value))
        if self.inner.key_of(line) != own:
            raise NoLineKey("codec and key function name different fields")
        self.inner.put(line)

    def get(self, key: bytes | str) -> bytes:
        from keylode.functions.keys import raw_field

        found = raw_field(self.inner.get(key), "value")
        if found is None:
            raise NotFound(key)
        return found.encode()

    def has(self, key: bytes | str) -> bool:
        return self.inner.has(key)

    def delete(self, key: bytes | str) -> None:
        self.inner.delete(key)

    def scan(self, prefix: bytes | str = b"", ordered: bool = False, reverse: bool = False) -> DataFrame:
        return self.inner.scan(prefix, ordered, reverse).withColumnRenamed("line", "value")

    def decoded(self, raw: Column) -> Column:
        return self.codec.value(raw)


class Bucket:
    """Typed records under a key prefix, put before keys as it is: end it with a mark
    that keys don't have, else buckets can run into one another."""

    def __init__(self, store: Store, prefix: str, codec: JsonCodec):
        self.store, self.prefix, self.codec = store, prefix, codec

    def _key(self, key: str) -> bytes:
        if not self.prefix and not key:
            raise EmptyKey("empty key")
        return (self.prefix + key).encode()

    def put(self, key: str, value: dict) -> None:
        self.store.put(self._key(key), json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())

    def get(self, key: str) -> dict:
        return json.loads(self.store.get(self._key(key)))

    def has(self, key: str) -> bool:
        return self.store.has(self._key(key))

    def delete(self, key: str) -> None:
        self.store.delete(self._key(key))

    def scan(self, prefix: str = "", ordered: bool = False, reverse: bool = False) -> DataFrame:
        """key without the bucket's prefix, and the decoded value; a value that can't be
        decoded fails the query."""
        rows = self.store.scan(self.prefix + prefix, ordered, reverse)
        short = F.substring(F.col("key").cast("string"), len(self.prefix) + 1, 2**31 - 1)
        return rows.select(short.alias("key"), self.codec.decode(self.store.decoded(F.col("value"))).alias("value"))

    def all(self, prefix: str = "", ordered: bool = False, reverse: bool = False) -> Iterator[tuple[str, dict]]:
        return ((r["key"], r["value"].asDict(recursive=True)) for r in self.scan(prefix, ordered, reverse).toLocalIterator())
