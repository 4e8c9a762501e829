"""A read-only sorted table over ordered line files.

A build is one reduction and one range-partitioned, sorted Parquet write with a Bloom
filter on the key.  Every build goes to a folder of its own; the manifest names the
current one, the sources as they were, the key function and the options, and is
replaced by one rename, so a reader never meets parts of two builds.
"""

from __future__ import annotations

import json
import threading
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylode.errors import Closed, Corrupt, NotFound, checked_key
from keylode.files import Files
from keylode.operators import scan
from keylode.plans.latest import latest, refreshed
from keylode.sources import lines

SCHEMA = T.StructType().add("key", "binary").add("file_idx", "integer").add("src_off", "long").add("len", "integer").add("line", "binary")
MOST_SOURCES = 65535
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


@dataclass(frozen=True)
class Options:
    """bloom_fpr: 0 means 1 %, negative none.  sparse_interval: most rows of one row
    group, the least that a lookup reads; 0 leaves groups to Parquet's block size.  chunk_entries has no effect: Spark sorts and spills by itself."""

    bloom_fpr: float = 0.0
    sparse_interval: int = 0
    chunk_entries: int = 0

    @property
    def rate(self) -> float:
        return 0.01 if self.bloom_fpr == 0 else self.bloom_fpr


@dataclass(frozen=True)
class KeyFunction:
    """A key function with a name that identifies it in manifests."""

    name: str
    column: Callable[[Column], Column]

    def __call__(self, line: Column) -> Column:
        return self.column(line)


def stats_of(spark: SparkSession, paths: Sequence[str]) -> list[dict]:
    files = Files(spark)
    return [{"path": p, "size": s, "mtime_ns": m} for p, (s, m) in ((p, files.stat(p)) for p in paths)]


def decide(recorded: list[dict], current: list[dict]) -> str:
    """fresh: the same sources; refresh: new ones after all recorded ones, which are
    unchanged; rebuild: anything else."""
    if recorded == current:
        return "fresh"
    return "refresh" if recorded and len(current) > len(recorded) and current[: len(recorded)] == recorded else "rebuild"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    files, name = Files(spark), f"{path}/manifest.json"
    if not files.exists(name):
        return None
    try:
        whole = files.read_json(name)
        body = json.dumps(whole["body"], sort_keys=True).encode()
        if zlib.crc32(body) != whole["crc32"] or not files.exists(f"{path}/{whole['body']['version']}"):
            raise Corrupt(name)
        return whole["body"]
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt(name) from e


def _write(spark: SparkSession, rows: DataFrame, path: str, stats: list[dict], key: KeyFunction, options: Options) -> None:
    before = _manifest_or_none(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMA)).repartitionByRange(parts, "key").sortWithinPartitions("key")
    out = ranged.write
    if options.sparse_interval > 0:
        out = out.option("parquet.block.row.count.limit", str(options.sparse_interval))
    if options.rate > 0:
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(options.rate))
        # a group's keys are distinct: as many as rows, or sized by what the group holds
        size = ("parquet.bloom.filter.expected.ndv#key", str(options.sparse_interval)) if options.sparse_interval > 0 else ("parquet.bloom.filter.adaptive.enabled", "true")
        out = out.option(*size)
    out.parquet(f"{path}/{version}")
    body = {"version": version, "sources": stats, "key": key.name, "options": asdict(options)}
    Files(spark).put(f"{path}/manifest.json", json.dumps({"body": body, "crc32": zlib.crc32(json.dumps(body, sort_keys=True).encode())}).encode())
    if before:
        Files(spark).delete(f"{path}/{before['version']}")


def _manifest_or_none(spark: SparkSession, path: str) -> dict | None:
    try:
        return _manifest(spark, path)
    except Corrupt:
        return None


def _check(paths: Sequence[str]) -> None:
    if len(paths) > MOST_SOURCES:
        raise ValueError(f"{len(paths)} sources; {MOST_SOURCES} at most")


def _build(spark: SparkSession, paths: Sequence[str], key: KeyFunction, path: str, options: Options, stats: list[dict]) -> None:
    rows = lines.sources(spark, paths, key) if paths else spark.createDataFrame([], SCHEMA)
    _write(spark, latest(rows.select(*SCHEMA.names), "key", ["file_idx", "src_off"]), path, stats, key, options)


def build(spark: SparkSession, paths: Sequence[str], key: KeyFunction, path: str, options: Options = Options()) -> None:
    _check(paths)
    with _LOCKS[path]:
        _build(spark, paths, key, path, options, stats_of(spark, paths))


def ensure_fresh(spark: SparkSession, paths: Sequence[str], path: str, key: KeyFunction, options: Options = Options()) -> SortedTable:
    """The table over these sources: reused, refreshed with new ones, or rebuilt.
    Another key function or other options mean a rebuild."""
    _check(paths)
    with _LOCKS[path]:
        current, recorded = stats_of(spark, paths), _manifest(spark, path)
        same = recorded is not None and recorded["key"] == key.name and recorded["options"] == asdict(options)
        what = decide(recorded["sources"], current) if same else "rebuild"
        if what == "refresh":
            known = len(recorded["sources"])
            existing = spark.read.schema(SCHEMA).parquet(f"{path}/{recorded['version']}")
            added = lines.sources(spark, paths[known:], key, known).select(*SCHEMA.names)
            _write(spark, refreshed(existing, added, "key", ["file_idx", "src_off"]), path, current, key, options)
        elif what == "rebuild":
            _build(spark, paths, key, path, options, current)
        return SortedTable(spark, path)


class SortedTable:
    def __init__(self, spark: SparkSession, path: str):
        manifest = _manifest(spark, path)
        if manifest is None:
            raise FileNotFoundError(f"{path}/manifest.json")
        self.path, self.manifest = path, manifest
        self._table: DataFrame | None = spark.read.schema(SCHEMA).parquet(f"{path}/{manifest['version']}")

    @property
    def source_paths(self) -> list[str]:
        return [s["path"] for s in self.manifest["sources"]]

    def table(self) -> DataFrame:
        if self._table is None:
            raise Closed(self.path)
        return self._table

    def get(self, key: bytes | str) -> bytes:
        found = scan.get(self.table(), "key", checked_key(key)).select("line").limit(1).collect()
        if not found:
            raise NotFound(key)
        return bytes(found[0][0])

    def has(self, key: bytes | str) -> bool:
        return bool(scan.get(self.table(), "key", checked_key(key)).select("key").limit(1).collect())

    def prefix(self, prefix: bytes | str = b"") -> DataFrame:
        return scan.scan(self.table(), "key", prefix.encode() if isinstance(prefix, str) else prefix, ordered=True)

    def all(self) -> DataFrame:
        return self.prefix()

    def filter_all(self, keep: Column | Callable[[str], Column]) -> DataFrame:
        return scan.filter_all(self.table(), keep).orderBy("key")

    def rows(self, prefix: bytes | str = b"") -> Iterator[tuple[bytes, bytes]]:
        return ((bytes(r["key"]), bytes(r["line"])) for r in self.prefix(prefix).select("key", "line").toLocalIterator())

    def __len__(self) -> int:
        return self.table().count()

    def close(self) -> None:
        self._table = None
