"""Named stores that are opened on first use and closed when idle."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from keylode.errors import Closed, ManagerClosed
from keylode.sources import sorted_table
from keylode.stores import LineStore, LogStore, Options


def checked_name(name: str) -> str:
    if name in ("", ".", "..") or any(c in name for c in "/\\\0"):
        raise ValueError(f"not a name: {name!r}")
    return name


@dataclass
class _Entry:
    resource: Any = None
    refs: int = 0
    idle_since: float = 0.0
    error: str | None = None
    lock: threading.Lock = field(default_factory=threading.Lock)


class Handle:
    """A hold on a resource; closing it twice counts once."""

    def __init__(self, pool: Pool, name: str, resource: Any):
        self._pool, self.name, self._resource, self._held = pool, name, resource, True

    @property
    def resource(self) -> Any:
        if not self._held:
            raise Closed(self.name)
        return self._resource

    def close(self) -> None:
        if self._held:
            self._held = False
            self._pool.release(self.name)

    def __enter__(self) -> Any:
        return self.resource

    def __exit__(self, *_: object) -> None:
        self.close()


class Pool:
    """sweep_s: seconds between sweeps of a thread of its own; 0 means that only sweep()
    closes idle resources."""

    def __init__(self, opener: Callable[..., Any], idle_s: float = 300.0, clock: Callable[[], float] = time.monotonic, sweep_s: float = 0.0):
        self._opener, self._idle, self._clock = opener, idle_s, clock
        self._entries: dict[str, _Entry] = {}
        self._lock, self._open = threading.Lock(), True
        self._stop = threading.Event()
        if sweep_s > 0:
            threading.Thread(target=self._reap, args=(sweep_s,), daemon=True).start()

    def _reap(self, every: float) -> None:
        while not self._stop.wait(every):
            self.sweep()

    def acquire(self, name: str, *more: Any) -> Handle:
        checked_name(name)
        with self._lock:
            if not self._open:
                raise ManagerClosed(name)
            entry = self._entries.setdefault(name, _Entry())
        with entry.lock:
            if entry.resource is None:
                entry.resource = self._opener(name, *more)
            entry.refs += 1
            return Handle(self, name, entry.resource)

    def release(self, name: str) -> None:
        entry = self._entries[name]
        with entry.lock:
            entry.refs -= 1
            entry.idle_since = self._clock()

    def sweep(self) -> None:
        """Close what nobody has held for the idle time."""
        for entry in list(self._entries.values()):
            with entry.lock:
                if entry.resource is not None and not entry.refs and self._clock() - entry.idle_since >= self._idle:
                    self._shut(entry)

    def _shut(self, entry: _Entry) -> None:
        try:
            entry.resource.close()
            entry.error = None
        except Exception as e:  # noqa: BLE001  told in stats; the next acquire opens anew
            entry.error = str(e)
        entry.resource = None

    def stats(self) -> list[dict]:
        with self._lock:
            now = self._clock()
            idle = lambda e: now - e.idle_since if e.resource is not None and not e.refs else None
            return [{"name": n, "open": e.resource is not None, "refs": e.refs, "idle_s": idle(e), "error": e.error} for n, e in sorted(self._entries.items())]

    def close(self) -> None:
        with self._lock:
            if not self._open:
                raise ManagerClosed("pool")
            self._open = False
        self._stop.set()
        for entry in self._entries.values():
            with entry.lock:
                if entry.resource is not None:
                    self._shut(entry)


def stats_frame(spark: SparkSession, pool: Pool) -> DataFrame:
    return spark.createDataFrame([(s["name"], s["open"], s["refs"], s["idle_s"], s["error"]) for s in pool.stats()], "name string, open boolean, refs int, idle_s double, error string")


class LogManager(Pool):
    """Log stores under a folder; the folder is forced, other options are the caller's."""

    def __init__(self, spark: SparkSession, base: str, options: Callable[[str], Options] = lambda _: Options(), **more: Any):
        super().__init__(lambda name: LogStore(spark, f"{base}/{name}", options(name)), **more)


class LineManager(Pool):
    def __init__(self, spark: SparkSession, base: str, key: Callable, key_of: Callable[[bytes], bytes | None], **more: Any):
        super().__init__(lambda name: LineStore(spark, f"{base}/{name}", key, key_of), **more)


class SortedManager(Pool):
    """Sorted tables built under a cache folder; acquire(name, source_paths)."""

    def __init__(self, spark: SparkSession, cache: str, key: sorted_table.KeyFunction, options: sorted_table.Options = sorted_table.Options(), **more: Any):
        def opener(name: str, paths: Sequence[str]) -> sorted_table.SortedTable:
            if not paths:
                raise ValueError("no sources")
            return sorted_table.ensure_fresh(spark, paths, f"{cache}/{name}", key, options)

        super().__init__(opener, **more)
