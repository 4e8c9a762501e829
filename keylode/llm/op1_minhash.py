"""MinHash near-duplicate detection of whole documents.

Universal hash minima of each document's five-word shingles are cut into bands.
Documents with equal shingle sets become one class first, so copies are never
compared.  Then, per colliding band:

1. every class is paired with the smallest class of its bucket; pairs whose
   signatures agree too little are dropped and the rest is verified on the full
   shingle sets; components follow from the links;
2. buckets that still hold more than one component are compared within, but only
   across components: small buckets as pairs, large ones as a grid of blocks that
   are compared inside a task and return no more than a spanning forest.

So no link that a band collision can show is lost, a bucket's pairs are never all
emitted, and a group of copies costs as much as its members.

Nulls count as empty texts.  Documents without words have no shingles, link with
nothing and stay.  Rows without an id get no verdict.  Rows that repeat an id are one
document, of their least text if texts differ, and each gets its verdict.  An empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.llm import textvec
from keylode.llm.components import components
from keylode.llm.participants import one_text, repeated_ids, texts_of
from keylode.llm.memory import settled
from keylode.llm.work import Work, read

#: 40 bands of 4 minima: a pair at similarity 0.75 meets in none with probability 2.5e-7.
BANDS, ROWS = 40, 4
PERCENT = 75
#: Share of equal minima below which a pair isn't verified: about five standard
#: deviations (0.034) under 0.75.
LEAST_EQUAL = 0.58
#: Buckets up to this size are compared as pairs, others in blocks of BLOCK.
PAIRS_UP_TO, BLOCK = 24, 256


class MinHash:
    """h -> (a * h + b) mod 2**64 for random odd a: universal in the upper bits."""

    def __init__(self, count: int = BANDS * ROWS, seed: int = 7):
        self.a = (textvec.stream(seed, count) | np.uint64(1))[:, None]
        self.b = textvec.stream(seed + 1000, count)[:, None]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The signature as one 64-bit number for each band of four 16-bit minima."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, values.size, 1024):
            least = np.minimum(least, (self.a * values[i : i + 1024] + self.b).min(axis=1))
        # mixed before the cut: the least of many hashes has few high bits left
        return (textvec.mix(least) >> np.uint64(48)).astype(np.uint16).view(np.int64)


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(blake2b(values.tobytes(), digest_size=16).digest(), np.int64).tolist())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a 128-bit fingerprint of the shingle set), bands."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, empty = MinHash(), np.zeros(0, np.int64)
        for batch in batches:
            for part in textvec.parts(batch, "text", 500):
                hashes, first, _, _ = textvec.words(part.column(1))
                n, f1, f2, bands = [], [], [], []
                known: dict[tuple[int, int], np.ndarray] = {}
                for row in textvec.shingles(hashes, first):
                    unique = np.unique(row)
                    key = _fingerprint(unique)
                    if key not in known:
                        known[key] = sign(unique) if unique.size else empty
                    n.append(unique.size)
                    f1.append(key[0])
                    f2.append(key[1])
                    bands.append(known[key])
                offsets = np.concatenate([[0], np.cumsum([x.size for x in bands])]).astype(np.int32)
                flat = pa.array(np.concatenate(bands) if bands else empty)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, f1 long, f2 long, bands array<long>")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough minima."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(c.flatten()).reshape(-1, BANDS).view(np.uint16) for c in (batch.column(2), batch.column(3)))
            ok = (x == y).mean(axis=1) >= LEAST_EQUAL
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (classes.select(F.col("rep").alias(k), F.col("bands").alias(f"bands_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "bands_a", "bands_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(x.size, y.size) < PERCENT * max(x.size, y.size):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (x.size + y.size - shared)


def _shingle_sets(column: pa.Array) -> list[np.ndarray]:
    hashes, first, _, _ = textvec.words(column)
    return [np.unique(x) for x in textvec.shingles(hashes, first)]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                ok, right = [], _shingle_sets(part.column(3))
                for i, a in enumerate(part.column(0).to_pylist()):
                    if a != last:
                        last, own = a, _shingle_sets(part.column(2).slice(i, 1))[0]
                    ok.append(_linked(own, right[i]))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _forest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Links within one block pair of one bucket that join different components."""
    band = int(key[1])
    rows = rows.drop_duplicates("rep").sort_values("rep").reset_index(drop=True)
    bands = np.stack(rows["bands"].to_numpy()) if len(rows) else np.zeros((0, BANDS), np.int64)
    minima = bands.view(np.uint16)
    sets = _shingle_sets(pa.array(rows["text"], pa.string()))
    reps, parent = rows["rep"].tolist(), {c: c for c in rows["component"].tolist()}
    comps = rows["component"].tolist()
    codes = rows["component"].astype("category").cat.codes.to_numpy()
    one_block = rows["chunk"].nunique() < 2
    chunk = rows["chunk"].to_numpy()

    def find(c: object) -> object:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out: list[tuple] = []
    for i in range(1, len(rows)):
        other = np.flatnonzero((codes[:i] != codes[i]) & (one_block | (chunk[:i] != chunk[i])))
        if not other.size:
            continue
        other = other[(bands[other] == bands[i]).argmax(axis=1) == band]  # others meet in an earlier band
        equal = (minima[other] == minima[i]).mean(axis=1)
        for j in other[np.argsort(-equal, kind="stable")][: int((equal >= LEAST_EQUAL).sum())]:
            x, y = find(comps[i]), find(comps[j])
            if x != y and _linked(sets[i], sets[j]):
                parent[max(x, y)] = min(x, y)
                out.append((reps[j], reps[i]))
    return pd.DataFrame(out, columns=["a", "b"])


def _across(members: DataFrame, comp: DataFrame, tested: DataFrame, classes: DataFrame, docs: DataFrame, work: Work) -> DataFrame:
    """Links across the components that are left in a bucket."""
    kind = classes.schema["rep"].dataType.simpleString()
    named = members.join(comp, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = named.groupBy("key", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi").drop("lo", "hi")
    left = work.table(named.join(open_, ["key", "band"]), "open")
    few = left.where(F.col("n") <= PAIRS_UP_TO)
    other = few.select("key", "band", F.col("rep").alias("b"), F.col("component").alias("other"))
    pairs = few.withColumnRenamed("rep", "a").join(other, ["key", "band"]).where("a < b and component <> other").select("a", "b").distinct()
    close = work.table(_alike(pairs.join(tested, ["a", "b"], "left_anti"), classes), "close")

    many = left.where(F.col("n") > PAIRS_UP_TO).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("chunk", F.expr("cast(pmod(xxhash64(rep, key), chunks) as int)"))
    ids = many.select(F.col("rep").alias("doc_id")).union(close.select("a")).union(close.select("b")).distinct()
    texts = work.table(texts_of(docs, ids), "open_texts")
    few_links = _verified(close, texts)
    laid = (
        many.join(texts.withColumnRenamed("doc_id", "rep"), "rep")
        .join(classes.select("rep", "bands"), "rep")
        .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("key", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "component", "bands", "text")
    )

    def blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[2] != key[3] and rows["chunk"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []})
        return _forest(key, rows)

    return few_links.union(laid.groupBy("key", "band", "i", "j").applyInPandas(blocks, f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    work = work or Work(docs.sparkSession, "minhash")
    rows = docs.select("doc_id", "text")
    docs = one_text(rows, work)
    signed = work.table(signatures(docs), "signed")
    grouped = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).where("rep is not null")
    classes = work.table(grouped, "classes")

    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key", "band").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = work.table(banded.join(shared, ["key", "band"]), "members")
    stars = members.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    tested = work.table(stars, "stars")
    close = work.table(_alike(tested, classes), "star_close")
    texts = work.table(texts_of(docs, close.select(F.col("a").alias("doc_id")).union(close.select("b")).distinct()), "star_texts")
    links = work.table(_verified(close, texts), "links")
    comp = work.table(components(links, work, "first"), "comp")
    work.drop("star_close", "star_texts")

    more = work.table(_across(members, comp, tested, classes, docs, work), "more_links")
    if more.head(1):
        both = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        comp = work.table(components(both, work, "second"), "comp2")
    work.drop("members", "stars", "open", "close", "open_texts")

    named = classes.select("rep", "f1", "f2").join(comp, F.col("rep") == F.col("node"), "left")
    found = work.table(named.select("f1", "f2", F.coalesce("component", "rep").alias("component")), "found")
    work.drop("classes", "links", "comp", "comp2", "more_links")
    out = signed.drop("bands").join(found, ["f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    if repeated_ids(rows.select("doc_id")) is not None:
        out = rows.select("doc_id").join(out, "doc_id")
    nameless = signatures(rows.where("doc_id is null")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
with recursive toks as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
),
sets as (
    select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from toks
),
sh as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (
    select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
    from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
),
links as (select a, b from shared where 100 * c >= 75 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (
    select distinct a, a from both_ways
    union
    select reach.doc_id, b from reach join both_ways on both_ways.a = reach.r
),
comp as (select doc_id, min(r) as c from reach group by 1)
select sets.doc_id, cast(len(s) as bigint) as n_shingles, coalesce(comp.c, sets.doc_id) as component_id, sets.doc_id = coalesce(comp.c, sets.doc_id) as kept
from sets left join comp using (doc_id)
"""

QUERY, ORACLE = ("op1_minhash", op1_minhash), SQL
