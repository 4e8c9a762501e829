"""Near-duplicate vectors through an inverted file with product-quantised residuals.

Equal vectors are one class.  Coarse centroids and subspace codebooks are fitted on at
most SAMPLE class vectors; every vector is indexed.  A vector lies in the list of its
nearest centroid and probes each list whose bisecting plane it is within margin() of: of
two vectors at cosine 0.95 (distance 0.316 at unit length), one is within 0.158 of the
plane between their lists.  Up to FULL components that is the margin, so no link is lost;
vectors of more components differ hardly ever just across a plane, and the margin shrinks
with the root of their number (0.097 for 64).
Within a list, codes give table-lookup distances; a pair is kept while the distance
less the code's own error (kept with each code) is within reach, so quantising loses
nothing.  What is left is ranked by exact cosine in double precision.

Lists are compared in a grid of blocks of BLOCK vectors, so a list of any length is
dealt over tasks.  A block pair returns link counts and a spanning forest, never its
pairs; components follow by large-star and small-star.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing.  Only vectors of equal length are compared, in the precision that they have.
Rows that repeat an id are one vector, the least one; ids are integers.  An empty table
gives an empty one.  Labels and other columns have no influence, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm.components import components
from keylode.llm.op9_topk import matrices, valid
from keylode.llm.work import Work, read

COSINE = 0.95
REACH = float(np.sqrt(2 - 2 * COSINE))
#: Vectors of up to so many components are searched without loss.
FULL = 24
SAMPLE, LISTS, PARTS, CODES, ROUNDS = 32_768, 4096, 8, 256, 8
BLOCK = 1024


def margin(dim: int) -> float:
    return REACH / 2 * min(1.0, float(np.sqrt(FULL / dim))) + 1e-9


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(-2 * x[i : i + 4096] @ c.T + (c * c).sum(axis=1)).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


class Index:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, total: int):
        lists = int(min(LISTS, max(1, 2 * np.sqrt(total)), max(1, len(x) // 8)))
        self.coarse = _kmeans(x, lists, 1)
        self.gap = np.sqrt(np.maximum(((self.coarse**2).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1)[None] - 2 * self.coarse @ self.coarse.T), 0))
        rest = x - self.coarse[np.concatenate([self.squared(x[i : i + 4096]).argmin(axis=1) for i in range(0, len(x), 4096)])]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1]))
        self.books = [_kmeans(rest[:, c], min(CODES, len(x)), 2 + i) for i, c in enumerate(self.cuts)]

    def squared(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(axis=1), 0)

    def margins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own list, and its distance from the plane towards each list."""
        d = self.squared(x)
        own = d.argmin(axis=1)
        away = (d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * self.gap[own], 1e-12)
        away[np.arange(len(x)), own] = 0
        return own, away

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each code is from its vector."""
        rest = x - self.coarse[own]
        codes = np.empty((len(x), len(self.cuts)), np.uint8)
        error = np.zeros(len(x))
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            d = np.maximum((rest[:, c] ** 2).sum(axis=1)[:, None] - 2 * rest[:, c] @ book.T + (book**2).sum(axis=1), 0)
            codes[:, i] = d.argmin(axis=1)
            error += d.min(axis=1)
        return codes, np.sqrt(error)

    def lookup(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from vectors to codes of one list."""
        rest, out = x - self.coarse[own], np.zeros((len(x), len(codes)))
        for i, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = (rest[:, c] ** 2).sum(axis=1)[:, None] - 2 * rest[:, c] @ book.T + (book**2).sum(axis=1)
            out += table[:, codes[:, i]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else very small components vanish in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fit(classes: DataFrame) -> dict[int, Index]:
    """An index for each vector length of a bounded sample."""
    rows = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toPandas()
    total = classes.count()
    out = {}
    for size, own in rows.groupby(rows["embedding"].map(len)):
        x = _unit(np.stack(own["embedding"].to_numpy()).astype(np.float64))
        out[int(size)] = Index(x, max(1, total * len(own) // max(1, len(rows))))
    return out


def _placed(classes: DataFrame, sent) -> DataFrame:
    """dim, list, entry (else a probing query), rep, size, embedding, codes, error."""
    element = classes.schema["embedding"].dataType.elementType.simpleString()
    stored = pa.float32() if element == "float" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for ids, x in matrices(batch, 2048):
                index = sent.value.get(x.shape[1])
                u = _unit(x)
                if index is None:  # a length that the sample hasn't: one list, no codes
                    row, lists, entry = np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool)
                    codes, error = np.zeros((len(x), 0), np.uint8), np.zeros(len(x))
                else:
                    own, away = index.margins(u)
                    row, lists = np.nonzero(away <= margin(x.shape[1]))
                    entry = lists == own[row]
                    codes, error = index.encode(u, own)
                flat = pa.array(x[row].astype(np.float64).ravel())
                steps = pa.array(np.arange(row.size + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(row.size, x.shape[1], np.int32)),
                        pa.array(lists.astype(np.int32)),
                        pa.array(entry),
                        pa.array(ids[row]),
                        pa.array([sizes[i] for i in ids[row].tolist()], pa.int64()),
                        pa.ListArray.from_arrays(steps, flat).cast(pa.list_(stored)),
                        pa.array([codes[i].tobytes() for i in row], pa.binary()),
                        pa.array(error[row]),
                    ],
                    names=["dim", "list", "entry", "rep", "size", "embedding", "codes", "error"],
                )

    return classes.select("rep", "embedding", "size").mapInArrow(run, f"dim int, list int, entry boolean, rep long, size long, embedding array<{'float' if element == 'float' else 'double'}>, codes binary, error double")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the pairs to the least node that it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: a.size], flat[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _compare(key: tuple, rows: pd.DataFrame, models: dict[int, Index]) -> pd.DataFrame:
    """(a, b, n): a forest edge where n is 0, else n links of the class a."""
    left, right = rows[rows["left"]], rows[~rows["left"]]
    empty = pd.DataFrame({"a": [], "b": [], "n": []})
    if not len(left) or not len(right):
        return empty
    dim, own = int(key[0]), int(key[1])
    index = models.get(dim)
    x, y = (np.stack(r["embedding"].to_numpy()).astype(np.float64) for r in (left, right))
    u, v = _unit(x), _unit(y)
    ids, other = left["rep"].to_numpy(), right["rep"].to_numpy()
    entry = right["entry"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(v), 256):
        part = slice(s, s + 256)
        if index is None:
            near = np.ones((len(v[part]), len(u)), bool)
        else:
            codes = np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1)
            far = np.sqrt(np.maximum(index.lookup(v[part], own, codes), 0))
            near = far <= REACH + left["error"].to_numpy() + 1e-6
        # a pair of entries is taken once
        near &= ~entry[part][:, None] | (other[part][:, None] < ids[None])
        i, j = np.nonzero(near)
        exact = np.einsum("ij,ij->i", v[part][i], u[j]) >= COSINE
        found.append((i[exact] + s, j[exact]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    if index is not None and i.size:  # found from both sides: the smaller id's probe counts
        reached = entry[i]
        asks = ~reached
        if asks.any():
            home = index.squared(v[i[asks]]).argmin(axis=1)
            _, away = index.margins(u[j[asks]])
            also = away[np.arange(home.size), home] <= margin(dim)
            keep = np.ones(i.size, bool)
            keep[np.flatnonzero(asks)] = ~also | (other[i[asks]] < ids[j[asks]])
            i, j = i[keep], j[keep]
    if not i.size:
        return empty
    sizes_l, sizes_r = left["size"].to_numpy(), right["size"].to_numpy()
    node, least = _forest(other[i], ids[j])
    counts = pd.DataFrame({"a": np.concatenate([other[i], ids[j]]), "n": np.concatenate([sizes_l[j], sizes_r[i]])}).groupby("a", as_index=False)["n"].sum()
    counts["b"] = counts["a"]
    edges = pd.DataFrame({"a": least, "b": node, "n": 0})
    return pd.concat([edges[edges["a"] != edges["b"]], counts[["a", "b", "n"]]])


def near_vectors(vectors: DataFrame, work: Work | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each id of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    work = work or Work(spark, "vectors")
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding")
    usable = valid(vectors).where(F.exists("embedding", lambda x: x != 0))
    classes = work.table(usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    member = usable.join(classes.select("embedding", "rep", "size"), "embedding").select("vec_id", "rep", "size")
    sent = spark.sparkContext.broadcast(_fit(classes))
    placed = work.table(_placed(classes, sent), "placed")
    # a row for each list: no more than LISTS for each vector length
    counts = placed.groupBy("dim", "list").agg(F.count_if("entry").alias("entries"), F.count("*").alias("all"))
    blocks = counts.select("dim", "list", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(f"n_{c}") for c in ("entries", "all")))
    rows = placed.join(blocks, ["dim", "list"]).withColumn("hash", F.xxhash64("rep"))
    mine = lambda n: F.pmod("hash", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "list", "i", "j", "left", "entry", "rep", "size", "embedding", "codes", "error"]
    lefts = rows.where("entry").withColumns({"i": mine("n_entries"), "left": F.lit(True)}).withColumn("j", every("n_all")).select(*columns)
    rights = rows.where("n_entries > 0").withColumns({"j": mine("n_all"), "left": F.lit(False)}).withColumn("i", every("n_entries")).select(*columns)
    found = lefts.union(rights).groupBy("dim", "list", "i", "j").applyInPandas(lambda key, part: _compare(key, part, sent.value), "a long, b long, n long")
    found = work.table(found, "found")
    comp = components(found.where("n = 0").select("a", "b"), work)
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    out = (
        vectors.where("vec_id is not null").select("vec_id").distinct()
        .join(member, "vec_id", "left")
        .join(links, "rep", "left")
        .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    )
    component = F.coalesce("component", "rep", "vec_id")
    n_links = (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
    select vec_id, min(embedding) as e from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    group by 1
),
w as (
    select vec_id, list_transform(e, lambda x: cast(x as double)) as e from v where len(list_filter(e, lambda x: x <> 0)) > 0
),
l as (
    select a.vec_id as a, b.vec_id as b from w a join w b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
),
reach(vec_id, r) as (
    select distinct a, a from l
    union
    select reach.vec_id, b from reach join l on l.a = reach.r
),
comp as (select vec_id, min(r) as c from reach group by 1),
deg as (select a as vec_id, count(*) as n from l group by 1)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, vec_id = coalesce(c, vec_id) as kept
from (select distinct vec_id from embeddings where vec_id is not null) left join deg using (vec_id) left join comp using (vec_id)
"""

QUERY, ORACLE = ("op8_vectors", op8_vectors), SQL
