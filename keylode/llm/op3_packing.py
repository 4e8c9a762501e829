"""Packing documents into sequences of 4096 tokens.

A document is its tokens and the end id; whole windows of 4096 are sequences of their
own, what is left over is a remainder.  The histogram of remainder lengths (steps of
16 tokens) of all documents is fitted by non-negative least squares with shallow
length combinations that fill a window: repeats of one length, of two, and triples.
The repeat counts, in proportion to a task's share of the documents and rounded so that
the tasks' counts come to the whole, are filled with the task's own remainders, the last
place of each by the longest that fits; residual remainders are packed greedily end to
end, cut where a window is full, and carried on to the task's next lot.  The sequence
that a task leaves open is put together with those of other tasks, longest first into
the fullest window that has room, so padding doesn't grow with the number of tasks.

Only the histogram (at most 257 rows) and the sizes of the open sequences (one for each
task) are gathered; no document is moved.  A lot holds at most LOT tokens, so memory is
bounded.  Null counts as an empty text, whose one token is the end id.  Repeated rows
are packed as often as they come; an empty table has no pieces; other columns have no
influence, whatever their names.  Token ids are kept in a table of the shared folder
between the two passes, and so are the pieces until open sequences are put together.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm import textvec
from keylode.llm.chunks import Words
from keylode.llm.memory import settled
from keylode.llm.work import Work, read

WINDOW, STEP, END = 4096, 16, 2
BINS = WINDOW // STEP
#: Tokens that a task packs at a time.
LOT = 12_000_000
#: In the numbers of sequences that residuals are put in.
RESIDUAL = 1 << 35
Pattern = tuple[tuple[int, int], ...]  # (bin, copies), ...


@cache
def _words(path: str) -> Words:
    """One table for each worker."""
    return Words(path)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, doc_tokens, ids (little-endian 16-bit where all fit, else 32-bit)."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for first, sizes, ids in words(batch.column(1), END):
                wide = "<u2" if ids.max() < 1 << 16 else "<u4"
                stops = np.concatenate([[0], np.cumsum(sizes)]) * np.dtype(wide).itemsize
                packed = pa.Array.from_buffers(pa.binary(), sizes.size, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(ids.astype(wide))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, sizes.size), pa.array(sizes, pa.int64()), packed], names=["doc_id", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, ids binary")


@cache
def combinations() -> tuple[Pattern, ...]:
    """Shallow combinations of bins whose lengths, rounded up, fill a window."""
    out = [((i, BINS // i),) for i in range(1, BINS) if BINS % i == 0]
    for i in range(1, BINS):
        for m in range(1, 9):
            left = BINS - m * i
            out += [((i, m), (left // n, n)) for n in range(1, 9 - m) if left > 0 and left % n == 0 and left // n > i]
    out += [((i, 1), (j, 1), (BINS - i - j, 1)) for i in range(1, BINS // 3) for j in range(i + 1, (BINS - i + 1) // 2)]
    return tuple(out)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| for x >= 0: Lawson and Hanson's active set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(4 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if w.max() <= tolerance:
            break
        active[w.argmax()] = True
        while True:
            own = np.flatnonzero(active)
            part = a[:, own]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(own.size), part.T @ b)
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            low = s <= 0
            step = (x[own][low] / np.maximum(x[own][low] - s[low], 1e-12)).min()
            x[own] += step * (s - x[own])
            gone = own[x[own] <= 1e-9]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int]) -> list[tuple[Pattern, float]]:
    """Combinations and their repeat counts for a histogram of bins."""
    patterns = combinations()
    a = np.zeros((BINS, len(patterns)))
    for k, pattern in enumerate(patterns):
        for i, copies in pattern:
            a[i - 1, k] += copies
    b = np.array([float(histogram.get(i, 0)) for i in range(1, BINS + 1)])
    x = nnls(a, b / max(1.0, b.max()))
    return [(patterns[k], float(x[k] * max(1.0, b.max()))) for k in np.flatnonzero(x > 1e-9)]


class Packer:
    """Packs the documents of one task, a lot at a time."""

    def __init__(self, patterns: list[tuple[Pattern, float]], total: int, task: int):
        self.patterns = sorted(patterns, key=lambda p: -p[1])
        self.total = max(1, total)
        self.next = task << 36
        self.open: int | None = None  # the sequence that residuals are put in
        self.filled = 0
        # what is owed of each count: a start within [0, 1) that differs between tasks makes up for rounding
        self.owed = (textvec.stream(task, len(patterns)) >> np.uint64(11)) / 2.0**53

    def _new(self, residual: bool = False) -> int:
        self.next += 1
        return self.next - 1 + RESIDUAL * residual

    def lot(self, sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) for documents of these sizes."""
        out = []
        bins: dict[int, deque[int]] = defaultdict(deque)
        for doc, size in enumerate(sizes):
            for k in range(size // WINDOW):
                out.append((doc, k * WINDOW, WINDOW, self._new(), 0))
            if size % WINDOW:
                bins[-(-(size % WINDOW) // STEP)].append(doc)
        share = sum(map(len, bins.values())) / self.total
        for k, (pattern, count) in enumerate(self.patterns):
            self.owed[k] += count * share
            due = int(self.owed[k])
            self.owed[k] -= due
            for _ in range(due):
                if any(len(bins[i]) < copies for i, copies in pattern):
                    break
                sequence, offset = self._new(), 0
                slots = [i for i, copies in sorted(pattern, reverse=True) for _ in range(copies)]
                for slot, i in enumerate(slots):
                    if slot and slot == len(slots) - 1:  # what the others' rounding left is used: the longest that fits
                        i = next((j for j in range((WINDOW - offset) // STEP, i, -1) if bins[j]), i)
                    doc = bins[i].popleft()
                    rest = sizes[doc] % WINDOW
                    out.append((doc, sizes[doc] - rest, rest, sequence, offset))
                    offset += rest
        for i in sorted(bins, reverse=True):
            for doc in bins[i]:
                at = sizes[doc] - sizes[doc] % WINDOW
                while at < sizes[doc]:
                    if self.open is None:
                        self.open, self.filled = self._new(True), 0
                    size = min(sizes[doc] - at, WINDOW - self.filled)
                    out.append((doc, at, size, self.open, self.filled))
                    at += size
                    self.filled += size
                    if self.filled == WINDOW:
                        self.open = None
        return out


def pack(encoded: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, doc_tokens, ids to one row for each piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the piece's ids."""
    rest = (F.col("doc_tokens") % WINDOW).alias("rest")
    counted = encoded.select(rest).where("rest > 0").groupBy(F.ceil(F.col("rest") / STEP).cast("int").alias("bin")).count().collect()
    histogram = {r["bin"]: r["count"] for r in counted}
    total = sum(histogram.values())
    sent = encoded.sparkSession.sparkContext.broadcast(plan(histogram))

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(sent.value, total, TaskContext.get().partitionId())

        def close(lot: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(lot).combine_chunks()
            sizes, blobs = whole.column(1).to_pylist(), whole.column(2)
            pieces = packer.lot(sizes)
            pieces.sort(key=lambda p: p[:2])
            for k in range(0, len(pieces), 5000):
                some = pieces[k : k + 5000]
                ids, last, own = [], None, np.zeros(0, "<u4")
                for doc, start, length, _, _ in some:
                    if doc != last:
                        blob, last = blobs[doc].as_py(), doc
                        own = np.frombuffer(blob, "<u2" if len(blob) == 2 * sizes[doc] else "<u4").astype("<u4")
                    ids.append(own[start : start + length].tobytes())
                rows = np.array([p[:5] for p in some], dtype=np.int64)
                columns = [
                    whole.column(0).combine_chunks().take(pa.array(rows[:, 0])),
                    pa.array(rows[:, 1]),
                    pa.array(rows[:, 2]),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([sizes[p[0]] for p in some], pa.int64()),
                    pa.array(rows[:, 3]),
                    pa.array(rows[:, 4]),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

        lot: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                lot.append(part)
                held += sum(part.column(1).to_pylist())
                if held >= LOT:
                    yield from close(lot)
                    lot, held = [], 0
        if lot:
            yield from close(lot)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "doc_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def joined(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Open sequences (number, tokens) put together: number, the sequence that takes
    it in, and its offset there.  Longest first, each into the fullest window that has
    room."""
    room: list[tuple[int, int]] = []  # of each window, with its sequence
    out = []
    for number, size in sorted(sizes, key=lambda s: (-s[1], s[0])):
        k = bisect_left(room, (size, -1))
        free, into = room.pop(k) if k < len(room) else (WINDOW, number)
        out.append((number, into, WINDOW - free))
        insort(room, (free - size, into))
    return out


def together(pieces: DataFrame) -> DataFrame:
    """Pieces with the tasks' open sequences (one for each) put together."""
    spark = pieces.sparkSession
    open_ = pieces.where(F.col("sequence_id").bitwiseAND(RESIDUAL) > 0).groupBy("sequence_id").agg(F.sum("length").alias("size")).where(F.col("size") < WINDOW)
    moves = [m for m in joined([(r[0], r[1]) for r in open_.collect()]) if m[0] != m[1]]
    if not moves:
        return pieces
    moved = F.broadcast(spark.createDataFrame(moves, "sequence_id long, into long, by long"))
    place = {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("by", F.lit(0))}
    return pieces.join(moved, "sequence_id", "left").withColumns(place).select(*pieces.columns)


def packed(docs: DataFrame, path: str, work: Work | None = None, with_ids: bool = False) -> DataFrame:
    work = work or Work(docs.sparkSession, "packing")
    pieces = work.table(pack(work.table(tokens(docs, path), "tokens"), with_ids), "pieces")
    work.drop("tokens")
    return together(pieces)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), tokenizer_path())


QUERY, ORACLE = ("op3_packing", op3_packing), None
