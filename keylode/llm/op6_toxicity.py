"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features are the distinct words, word stems (their first four and five bytes),
bigrams and one-word skip-grams of the whole text, hashed into 2**20 coordinates.
FTRL-proximal (McMahan et al., 2013) keeps a learning rate for each coordinate and
its L1 term leaves a few hundred weights, which are broadcast; the number of
coordinates bounds them (12 MB).

The model is fitted on at most TRAIN_ROWS labelled rows (those of the smallest hash).
Their features are hashed where the texts lie; one task gets each row's distinct
coordinates (2**20 of four bytes at most) and makes PASSES passes over them.  Rows whose
crc32(doc_id) mod 5 is 0 are held out.  Labels, language, source and id never enter a
score.  Rates, L1 and passes were chosen by cross-validation within the other rows.

Null and empty texts have no features and score the bias alone.  Labelled rows that
repeat count once, with the higher label; of several texts of one id the least is learnt
from, and every row is scored by its own text.  Without any labelled row every score is
0.  An empty table gives an empty one; other columns have no influence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm import textvec
from keylode.llm.memory import settled
from keylode.llm.work import Work, read

BITS = 20
TRAIN_ROWS = 12_000
PASSES = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
STEMS = (4, 5)
BIAS = 0  # this coordinate is in every text


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every feature, with repeats."""
    hashes, first, start, end = textvec.words(column)
    offsets, raw = textvec.buffers(column)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    seed = textvec.stream(31, 3 + len(STEMS))
    shift = np.uint64(64 - BITS)
    rows, found = [row], [textvec.mix(hashes ^ seed[0])]
    for k, gap in ((1, 1), (2, 2)):
        if hashes.size > gap:
            within = row[gap:] == row[:-gap]
            rows.append(row[gap:][within])
            found.append(textvec.mix((hashes[:-gap] * np.uint64(3) + hashes[gap:] * np.uint64(5))[within] ^ seed[k]))
    if raw.size:
        begin = start + offsets[:-1][row]
        for k, size in enumerate(STEMS):
            long = end - start >= size
            code = np.zeros(int(long.sum()), np.uint64)
            for j in range(size):
                code = (code << np.uint64(8)) | textvec._LOWER[raw[begin[long] + j]].astype(np.uint64)
            rows.append(row[long])
            found.append(textvec.mix(code ^ seed[3 + k]))
    index = (np.concatenate(found) >> shift).astype(np.int64)
    index[index == BIAS] = 1
    return np.concatenate(rows), index


class Ftrl:
    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def coordinates(column: pa.Array) -> list[np.ndarray]:
    """The distinct coordinates of each text, the bias among them."""
    row, index = features(column)
    pair = np.unique(np.concatenate([row * (1 << BITS) + index, np.arange(len(column)) * (1 << BITS) + BIAS]))
    bounds = np.searchsorted(pair, np.arange(1, len(column)) << BITS)
    return [x.astype(np.int32) for x in np.split(pair & ((1 << BITS) - 1), bounds)] if len(column) else []


def learnt(rows: list[tuple[np.ndarray, int]]) -> Ftrl:
    model = Ftrl()
    for _ in range(PASSES):
        for at, label in rows:
            model.learn(at, label)
    return model


@settled
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textvec.parts(batch, "text", 100):
            packed = [zlib.compress(np.diff(x, prepend=np.int32(0)).tobytes(), 1) for x in coordinates(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "at"])


@settled
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacked = lambda x: np.cumsum(np.frombuffer(zlib.decompress(x.as_buffer()), np.int32), dtype=np.int32)
    rows = [(unpacked(at), label) for batch in batches for at, label in zip(batch.column(1), batch.column(0).to_pylist(), strict=True)]
    model = learnt(rows)
    at = np.flatnonzero(model.weights(np.arange(1 << BITS)))
    if rows:
        at = np.union1d(at, [BIAS])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.weights(at))], names=["coordinate", "weight"])


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, work: Work | None = None) -> dict[str, np.ndarray]:
    """The coordinates with a weight, and the weights."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS ids: the rows of their texts are few, so the least text costs little
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = rows.mapInArrow(_hashed, f"doc_id {kind}, toxic int, at binary")
    ordered = hashed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("toxic", "at")
    model = ordered.mapInArrow(_train, "coordinate long, weight double").toPandas()
    return {"coordinate": model["coordinate"].to_numpy(np.int64), "weight": model["weight"].to_numpy(float)}


def score(docs: DataFrame, model: dict[str, np.ndarray], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score and whether it is 0.5 or more (as int) appended under names,
    which replace columns of docs that are called so."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        coordinate = sent.value["coordinate"]
        weights[coordinate] = sent.value["weight"]
        bias = float(weights[BIAS])
        for batch in batches:
            for part in textvec.parts(batch, "text", 400):
                row, index = features(part.column("text"))
                hit = np.flatnonzero(weights[index])
                pair = np.unique(row[hit] * (1 << BITS) + index[hit])
                total = np.bincount(pair >> BITS, weights=weights[pair & ((1 << BITS) - 1)], minlength=part.num_rows) + bias
                value = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if coordinate.size else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                    names=[*part.schema.names, *names],
                )

    own = [c for c in docs.columns if c not in names]
    shape = docs.select(*own).schema.add(names[0], "double").add(names[1], "integer")
    return docs.select(*own).mapInArrow(run, shape)


def toxicity(docs: DataFrame, labels: DataFrame, work: Work | None = None) -> DataFrame:
    return score(docs, fit(docs, labels, work))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    # only the id and the text leave the scan; the scored rows carry the id alone
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERY, ORACLE = ("op6_toxicity", op6_toxicity), None
