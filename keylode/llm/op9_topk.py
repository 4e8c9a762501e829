"""Exact top-k by integer inner product with block-at-a-time pruning.

Vectors are cut into chunks of document ranges; each chunk has a block-forward index:
blocks of BLOCK vectors with every term's greatest and least weight.  For each query,
the blocks of a chunk are ordered by their bound (the sum over terms of query weight
times the better of the two extremes) and scored in that order until the bound falls
below the query's kth score so far; at equality scoring goes on, as ties go to smaller
ids.  Every task keeps its best k for each query; the best of those are the result.

Queries are packed into chunks too and sent once to each of the salts that document
chunks are dealt over, SALTS at most; documents move once.  Neither side is broadcast or
gathered: the join is a merge join by hint, since Spark's estimate of the queries' size
leaves out that they are sent to each salt.

Weights are floor(256 * x).  Products of weights under 2**20 are summed in floating
point, which is exact; vectors with a larger weight are kept in chunks of their own and
compared in Python's integers (slower, without bounds); a score beyond 64 bits ranks by its
value and is given as the nearest 64-bit integer.  Vectors that are null, empty or hold
null or non-finite components take no part.  Only vectors of equal length are compared.
Rows that repeat an id are one vector, the least one; ids are integers.  A query without
other vectors has no rows; an empty table gives an empty one.  Other columns have no
influence, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import floor
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylode.llm.work import read

EVERY, TOP = 50, 5
CHUNK, QUERIES, BLOCK = 4096, 1024, 128
#: Weights below this give sums of up to 2**13 products under 2**53.
EXACT = 2.0**20
#: Document chunks are dealt over so many salts at most; a query moves once to each.
SALTS = 96
#: States of query chunks that a task holds before it hands the oldest on.
HELD = 128


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: one row for each id, with finite components only."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("vec_id is not null").where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and components of the vectors of a batch, by length, in id order."""
    ids, column = np.asarray(batch.column(0)), batch.column(1)
    sizes = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()).astype(np.float64), np.cumsum(sizes)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(ids[own], kind="stable")]
        for i in range(0, own.size, most):
            some = own[i : i + most]
            yield ids[some], flat[(ends[some] - size)[:, None] + np.arange(size)]


def _chunks(rows: DataFrame, most: int, names: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for ids, x in matrices(whole, most):
                with np.errstate(over="ignore"):
                    w = np.floor(256.0 * x)
                big = ~((np.abs(w) < EXACT).all(axis=1) & (x.shape[1] <= 1 << 13))
                for large in (False, True):
                    own = big == large
                    if own.any():
                        stored = x[own].astype("<f8") if large else w[own].astype("<i4")
                        yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([large]), pa.array([ids[own].astype("<i8").tobytes()]), pa.array([stored.tobytes()])], names=["dim", f"{names[0]}_large", *names])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= most:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    return rows.select("vec_id", "embedding").mapInArrow(run, f"dim int, {names[0]}_large boolean, {names[0]} binary, {names[1]} binary")


class _Best:
    """The best k so far of each query of a chunk."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, k: int):
        self.ids, self.weights = ids, weights
        self.score = np.full((ids.size, k), -np.inf)
        self.vec = np.full((ids.size, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        k = self.score.shape[1]
        new = (score >= self.score[rows, -1:]).any(axis=1)
        rows, score = rows[new], score[new]
        both = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.vec[rows], np.broadcast_to(vec, score.shape)], axis=1)
        order = np.lexsort((ids, -both), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(both, order, axis=1)
        self.vec[rows] = np.take_along_axis(ids, order, axis=1)

    def scan(self, ids: np.ndarray, weights: np.ndarray) -> None:
        """Score a chunk's blocks in the order of their bounds."""
        starts = np.arange(0, ids.size, BLOCK)
        high, low = np.maximum.reduceat(weights, starts), np.minimum.reduceat(weights, starts)
        bound = np.maximum(self.weights, 0) @ high.T + np.minimum(self.weights, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(self.ids.size)
        for step in range(starts.size):
            block = order[live, step]
            going = bound[live, block] >= self.score[live, -1]
            live, block = live[going], block[going]
            if not live.size:
                break
            for b in np.unique(block):
                rows = live[block == b]
                own = slice(starts[b], starts[b] + BLOCK)
                score = self.weights[rows] @ weights[own].T
                score[self.ids[rows][:, None] == ids[own][None]] = -np.inf
                self.add(rows, score, ids[own])

    def rows(self) -> pa.RecordBatch:
        q, k = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.vec[q, k]), pa.array(self.score[q, k].astype(np.int64))], names=["query_id", "vec_id", "score"])


class _BestLarge:
    """The same for pairs of chunks with weights whose sums need Python's integers."""

    def __init__(self, ids: np.ndarray, weights: list[list[int]], k: int):
        self.ids, self.weights, self.k = ids.tolist(), weights, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.ids]

    def scan(self, ids: np.ndarray, weights: list[list[int]]) -> None:
        docs = list(zip(ids.tolist(), weights, strict=True))
        for query, own, found in zip(self.ids, self.weights, self.found, strict=True):
            found += [(-sum(map(mul, own, w)), i) for i, w in docs if i != query]
            found.sort()
            del found[self.k :]

    def rows(self) -> pa.RecordBatch:
        out = [(q, i, -s) for q, found in zip(self.ids, self.found, strict=True) for s, i in found]
        near = [max(-(2**63), min(2**63 - 1, s)) for _, _, s in out]
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(near, pa.int64())], names=["query_id", "vec_id", "score"])


def _small(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.float64)


def _large(raw: bytes, dim: int, large: bool) -> list[list[int]]:
    if not large:
        return np.frombuffer(raw, "<i4").reshape(-1, dim).tolist()
    whole = lambda x: 256 * int(x) if abs(x) >= 2.0**52 else floor(256.0 * x)
    return [list(map(whole, row)) for row in np.frombuffer(raw, "<f8").reshape(-1, dim).tolist()]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of all vectors for each query, both
    as (vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors, queries = (x.select(F.col("vec_id").cast("long"), "embedding") for x in (vectors, queries))
    salts = min(SALTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = _chunks(vectors, CHUNK, ("ids", "weights")).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    asked = _chunks(queries, QUERIES, ("query_ids", "query_weights")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple[bool, bytes], _Best | _BestLarge] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids_large, ids, weights, query_large, query_ids, query_weights = (batch.column(c)[i].as_py() for c in range(7))
                large = ids_large or query_large
                best = held.pop((large, query_ids), None)
                if best is None:
                    asks = np.frombuffer(query_ids, "<i8")
                    best = _BestLarge(asks, _large(query_weights, dim, query_large), k) if large else _Best(asks, _small(query_weights, dim), k)
                held[large, query_ids] = best
                best.scan(np.frombuffer(ids, "<i8"), _large(weights, dim, ids_large) if large else _small(weights, dim))
                if len(held) > HELD:
                    yield held.popitem(last=False)[1].rows()
        for best in held.values():
            yield best.rows()

    pairs = docs.hint("merge").join(asked.hint("merge"), ["dim", "salt"]).select("dim", "ids_large", "ids", "weights", "query_ids_large", "query_ids", "query_weights")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
with v as (
    select vec_id, min(embedding) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    group by 1
),
w as (select vec_id, list_transform(e, lambda x: floor(256 * cast(x as double))) as e from v),
scored as (
    select q.vec_id as query_id, d.vec_id, cast(list_dot_product(q.e, d.e) as bigint) as score
    from w q join w d on q.vec_id <> d.vec_id and len(q.e) = len(d.e) where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""

QUERY, ORACLE = ("op9_topk", op9_topk), SQL
