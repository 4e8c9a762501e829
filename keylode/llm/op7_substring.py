"""Passages that repeat across documents, and their removal.

A paragraph is any run of 50 consecutive words (46 five-word shingles), wherever line
ends fall.  Each paragraph of a document is reduced to its MinHash minima in six bands;
neighbouring paragraphs mostly share their minima, so a document keeps few.  The key of a
minimum is its shingle with five words on either side, so phrases that are shorter collide
with nothing.  Documents with a colliding paragraph are linked in two steps:

1. every document is compared with one other: of the smallest documents of its keys,
   the one that shares most of them;
2. of each key's places that no chain of passages links yet, all are tested against each
   other: the shingles of the paragraphs that can hold the key (102 at most) must have a
   passage around the key.  Equal surroundings are one class, tested once, and two that a
   chain links meanwhile need no test of their own; each test that joins two chains makes
   one pair of documents, which are then compared whole.  If that shows no passage there,
   the one around the key counts.

So no place of a key is left out that has a passage in common with another one there,
whatever else the documents share (in texts that repeat themselves: a passage that brings
these two places together); a key of n places makes n - 1 pairs at most, and has no
cap.  A document's places of one key stand each for itself.

Passages are read off the full shingle sequences: runs of shingles in the same order
whose exact Jaccard similarity is 0.75 or more, cut at their widest gaps until it is, and
of a paragraph's length (44 words where its ends were edited).  A shingle counts at all
its places in the other text; passages that overlap are one where they are similar
together.  Passages are clustered by connected components; one of each component
(smallest document, then start) stays, the others go.

An exact paragraph collides in a band with probability 0.78 at least (its minimum's key
lies within it), so in none with about 1e-4; one of 50 words at Jaccard 0.75 with about
0.5, so in none with 0.016.  A line of a dozen words that many documents share makes no candidates.  A
document's pairs are compared in blocks of BLOCK, so the text of a centre of many copies
is sent once for each block.

Null texts count as empty, and texts under 50 words hold no passage; rows without an
id are passed on as they are.  Rows that repeat an id are one document, of their least
text if texts differ (without_repeats takes each text by itself).  Repeats within a
single document stay; an empty table has no passages.  Other columns are carried along
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylode.llm import textvec
from keylode.llm.components import components
from keylode.llm.participants import OWN, bounded, one_text, texts_of, versions
from keylode.llm.memory import settled
from keylode.llm.work import Work, read

K, WORDS, BANDS = 5, 50, 6
#: Words on either side of a minimum that belong to its key.
AROUND = 5
WINDOW = WORDS - K + 1
PERCENT = 75
#: Bands that two documents must share to meet, in whatever step.
LEAST_BANDS = 1, 1
#: Places of one text that passages bring to one point differ by so many words at most
#: (edits before it move it).
DRIFT = 32
#: Documents that the text of a centre is sent with.
BLOCK = 64
#: A passage may lose this many shingles in a row (an edited word costs five).
GAP = 16
#: The least length of a passage in shingles: what two paragraphs of equal length share
#: at Jaccard 0.75, so that edited ends don't hide one.
LEAST_LENGTH = -(-2 * WINDOW * PERCENT // (100 + PERCENT))
#: The longest exact run of a passage in shingles, at least.  Between two runs four
#: shingles or more of either text are lost, a quarter of the union at most; so a passage of
#: the least length has one gap at most and a run of 15, longer ones have runs of 24.
LEAST_RUN = 12
#: So many places of shingles are looked at in one go (a few bytes each); passages of texts
#: that repeat themselves more are found in overlapping slices of the text.
PLACES = 1 << 20
#: The most shingles before a key's in the paragraphs that can hold it, and after it.
AHEAD = WINDOW - 1 + AROUND
#: Bytes of text that are looked at in one go.
PART = 1 << 20
#: Columns that are joined to documents for a moment.
ID, CUT = "__keylode_id", "__keylode_cut"
#: What pairs bring to _matches.
KNOWN = "array<struct<s: int, e: int, p: int, q: int, b_at: int, a_at: int>>"


def _least(body: np.ndarray, seed: int) -> np.ndarray:
    """The place of the least hash of each WINDOW consecutive shingles."""
    v = body * (textvec.stream(seed, 1)[0] | np.uint64(1)) >> np.uint64(32) << np.uint64(32) | np.arange(body.size, dtype=np.uint64)
    wide = 1
    while wide * 2 <= WINDOW:
        v = np.minimum(v[:-wide], v[wide:])
        wide *= 2
    rest = WINDOW - wide
    v = np.minimum(v[:-rest], v[rest:]) if rest else v
    return (v & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs_around(body: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the words from AROUND before to AROUND after the shingles at these
    places; at the ends of the rows, of shingles lo to hi, of as many words within."""
    first = np.clip(at - AROUND, lo, hi - 2 * AROUND - 1)
    out = body[first].copy()
    for step in (AROUND, 2 * AROUND):
        out = textvec.mix(out + body[first + step])
    return out


def _content(body: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of all paragraphs that can hold the keys of these places."""
    first = np.clip(at - AROUND, lo, hi - 2 * AROUND - 1)
    begin, end = np.maximum(lo, first - WINDOW + 1), np.minimum(hi, first + 2 * AROUND + WINDOW)
    out = ((first - begin) * 4 * WINDOW + end - begin).astype(np.uint64)
    for step in range(0, 2 * (WINDOW + AROUND), K):
        out = textvec.mix(out + body[np.minimum(begin + step, end - 1)])
    return textvec.mix(out + body[end - 1])


def paragraph_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key, at: for each band the minima of the document's paragraphs, each with
    the words around it, at all its places whose paragraphs differ; `at` is the minimum's
    place, in words.  The three low bits of a key name its band."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.parts(batch, "text", 500, PART):
                hashes, first, _, _ = textvec.words(part.column(1))
                size = np.diff(first)
                whole = np.maximum(size - WORDS + 1, 0)  # paragraphs of each row
                if not whole.any():
                    continue
                body = textvec.shingle_body(hashes, K)
                row = np.repeat(np.arange(part.num_rows), whole)
                paragraph = np.arange(row.size) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(first[:-1], whole)
                for band in range(BANDS):
                    at = _least(body, 11 + band)[paragraph]
                    new = np.ones(at.size, bool)
                    new[1:] = at[1:] != at[:-1]
                    at, own = at[new], row[new]
                    key = _runs_around(body, at, first[own], first[own + 1] - K + 1) & ~np.uint64(7) | np.uint64(band)
                    name = key ^ textvec.mix(own.astype(np.uint64))
                    _, same, count = np.unique(name, return_inverse=True, return_counts=True)
                    again = np.flatnonzero(count[same] > 1)
                    if again.size:
                        name[again] = textvec.mix(name[again]) + _content(body, at[again], first[own[again]], first[own[again] + 1] - K + 1)
                        _, once = np.unique(name, return_index=True)
                        at, own, key = at[once], own[once], key[once]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(key.view(np.int64)), pa.array((at - first[own]).astype(np.int32))], names=["doc_id", "key", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key long, at int")


def _segments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Maximal runs of shingles that y and x share, at all their places in x: rows of
    (place in x less place in y, start in y, end in y)."""
    none = np.zeros((0, 3), np.int64)
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    lo = np.searchsorted(ranked, y)
    count = np.searchsorted(ranked, y, side="right") - lo
    if np.count_nonzero(count) * 100 < WINDOW * PERCENT:
        return none
    out, at = [], 0
    total = np.concatenate([[0], np.cumsum(count)])
    while at < y.size:  # slices of y with so many places, two of them share a paragraph
        to = max(at + 4 * WINDOW, int(np.searchsorted(total, total[at] + PLACES, side="right")) - 1)
        n = count[at:to]
        i = np.repeat(np.arange(at, at + n.size), n)
        p = order[np.arange(i.size) - np.repeat(total[at : at + n.size] - total[at], n) + np.repeat(lo[at:to], n)]
        stop = at + n.size
        begins = (i == at) | (p == 0) | (y[i - 1] != x[p - 1])
        ends = (i == stop - 1) | (p == x.size - 1) | (y[np.minimum(i + 1, y.size - 1)] != x[np.minimum(p + 1, x.size - 1)])
        d, s, z, e = p[begins] - i[begins], i[begins], p[ends] - i[ends], i[ends]
        first, last = np.lexsort((s, d)), np.lexsort((e, z))
        out.append(np.stack([d[first], s[first], e[last] + 1], axis=1))
        if stop == y.size:
            break
        at = stop - 2 * WINDOW
    return np.concatenate(out) if out else none


def _thinned(seg: np.ndarray) -> np.ndarray:
    """Segments less those that others hold: of long ones (exact passages) as many as
    show every LEAST_LENGTH shingles that they show, of others those outside them and
    outside others on near diagonals.  Text that repeats itself matches at all its places;
    so it costs no more than others."""
    size = seg[:, 2] - seg[:, 1]
    long, seg = seg[size >= LEAST_LENGTH], seg[size < LEAST_LENGTH]
    if len(seg) > 1:
        band = seg[:, 0] // GAP
        order = np.lexsort((-seg[:, 2], seg[:, 1], band))
        seg, band = seg[order], band[order]
        reach = np.maximum.accumulate(seg[:, 2] + (band - band[0]) * (int(seg[:, 2].max()) + 1))
        inside = (reach[:-1] >= seg[1:, 2] + (band[1:] - band[0]) * (int(seg[:, 2].max()) + 1)) & (band[1:] == band[:-1])
        seg = seg[np.append(True, ~inside)]
    if not len(long):
        return seg
    long = long[np.lexsort((long[:, 0], -long[:, 2], long[:, 1]))]
    kept, best, end = [], -1, -1
    starts, ends = long[:, 1].tolist(), long[:, 2].tolist()
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        if best >= 0 and s > end - LEAST_LENGTH + 1:  # what comes can't follow without a gap: take the furthest so far
            kept.append(best)
            end, best = ends[best], -1
        if e > end:
            if not kept or s > end - LEAST_LENGTH + 1:
                kept.append(i)
                end = e
            elif best < 0 or e > ends[best]:
                best = i
    if best >= 0:
        kept.append(best)
    chosen = long[kept]
    lo, hi = chosen[:, 1], np.maximum.accumulate(chosen[:, 2])
    at = np.searchsorted(lo, seg[:, 1], side="right") - 1
    return np.concatenate([chosen, seg[(at < 0) | (hi[at] < seg[:, 2])]])


def _groups(seg: np.ndarray) -> Iterator[np.ndarray]:
    """Segments on near diagonals and near in y that are long enough together."""
    todo = [(seg, 0, 0)]
    while todo:
        part, by, whole = todo.pop()
        if not len(part) or part[:, 2].max() - part[:, 1].min() < LEAST_LENGTH or (part[:, 2] - part[:, 1]).max() < LEAST_RUN:
            continue
        if whole == 2 or len(part) == 1:
            yield part
            continue
        part = part[np.argsort(part[:, by], kind="stable")]
        space = np.diff(part[:, 0]) > GAP if by == 0 else part[1:, 1] - np.maximum.accumulate(part[:, 2])[:-1] >= GAP
        cut = np.flatnonzero(space) + 1
        todo += [(p, 1 - by, 0 if cut.size else whole + 1) for p in np.split(part, cut)]


def _chain(seg: np.ndarray, seed: int) -> list[int]:
    """The seed and the segments that best go on from it at either end; segments are
    in order of their start."""
    chain, widest = [seed], int((seg[:, 2] - seg[:, 1]).max())
    for way in (1, -1):
        d, s, e = seg[seed].tolist()
        while True:
            lo, hi = (s, e + GAP) if way > 0 else (s - GAP - widest, s)
            lo, hi = np.searchsorted(seg[:, 1], (lo, hi)).tolist()
            dd, ss, ee = seg[lo:hi].T
            if way > 0:
                ahead, space, gain = (ss > s) & (ee > e) & (ee + dd > e + d), ss - e, ee - e
            else:
                ahead, space, gain = (ss < s) & (ee < e) & (ss + dd < s + d), s - ee, s - ss
            near = np.flatnonzero(ahead & (space < GAP) & (np.abs(dd - d) <= GAP))
            if not near.size:
                break
            k = lo + int(near[(np.maximum(space[near], 0) + np.abs(dd[near] - d) - gain[near]).argmin()])
            chain.append(k)
            d, s, e = seg[k].tolist()
    return sorted(chain)


def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Passages of y found in x: (start, end) in y's words, then in x's."""
    if min(x.size, y.size) < LEAST_LENGTH:
        return []
    if y.size <= x.size and (x[: y.size] == y).all():  # all of y, and all that repeats itself in it
        return [(0, y.size + K - 1, 0, y.size + K - 1)]
    out: list[tuple[int, int, int, int]] = []

    def held(a: int, b: int) -> bool:
        return any(u <= a and b <= v - K + 1 for u, v, _, _ in out)

    def add(chain: np.ndarray) -> None:  # what one place of x holds needs no other place
        for one in sorted(_cut(x, y, chain), key=lambda f: f[0] - f[1]):
            if not held(one[0], one[1] - K + 1):
                out.append(one)

    for seg in sorted(_groups(_thinned(_segments(x, y))), key=lambda g: int(g[:, 1].min() - g[:, 2].max())):
        seg = seg[[not held(u, v) for u, v in seg[:, 1:].tolist()]]
        if not len(seg):
            continue
        seg = seg[np.lexsort((seg[:, 2], seg[:, 1]))]
        (d, s, e), on = seg.T, slice(1, None)
        used = np.zeros(len(seg), bool)
        if (s[on] >= e[:-1]).all() and (s[on] + d[on] >= e[:-1] + d[:-1]).all() and (np.abs(np.diff(d)) <= GAP).all():
            used[:] = True
            add(seg)
        for seed in np.argsort(s - e, kind="stable").tolist():
            if e[seed] - s[seed] < LEAST_RUN:
                break
            if not used[seed] and not held(s[seed], e[seed]):
                free = np.flatnonzero(~used)  # what a chain has taken isn't cut again
                chain = free[_chain(seg[free], int(np.searchsorted(free, seed)))]
                used[chain] = True
                add(seg[chain])
            if e[seed] - s[seed] >= LEAST_LENGTH and not held(s[seed], e[seed]):
                add(seg[[seed]])  # an exact passage by itself, whatever its chain came to
    return _merged(x, y, sorted(set(out)))


def _merged(x: np.ndarray, y: np.ndarray, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans in order of their start, those that overlap in y as one where it is similar
    enough: text that repeats itself matches at many places."""
    out = spans[:1]
    for s, e, p, q in spans[1:]:
        u, v, m, n = out[-1]
        hull = u, max(e, v), min(p, m), max(q, n)
        if s < v and (hull == out[-1] or _similar(y[u : hull[1] - K + 1], x[hull[2] : hull[3] - K + 1])):
            out[-1] = hull
        else:
            out.append((s, e, p, q))
    return out


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    own, other = np.unique(a), np.unique(b)
    shared = np.intersect1d(own, other, assume_unique=True).size
    return 100 * shared >= PERCENT * (own.size + other.size - shared)


def _cut(x: np.ndarray, y: np.ndarray, chain: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The passages of a chain of segments."""
    hits, places, end = [], [], -1
    for d, s, e in chain.tolist():
        own = np.arange(max(s, end), e)
        hits.append(own)
        places.append(own + d)
        end = max(end, e)
    hit, pos = np.concatenate(hits), np.concatenate(places)
    out, todo = [], [(0, hit.size)]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or hit[b - 1] + 1 - hit[a] < LEAST_LENGTH:
            continue
        if passage := _passage(x, y, hit[a:b], pos[a:b]):
            out.append(passage)
        else:  # too much was edited: cut at the widest gap, of equal ones at the middle one
            gaps = np.maximum(np.diff(hit[a:b]), np.abs(np.diff(pos[a:b])))
            widest = np.flatnonzero(gaps == gaps.max())
            cut = a + 1 + int(widest[np.abs(widest - gaps.size // 2).argmin()])
            todo += [(a, cut), (cut, b)]
    return out


def _passage(x: np.ndarray, y: np.ndarray, hit: np.ndarray, pos: np.ndarray) -> tuple[int, int, int, int] | None:
    """The stretch of these hits, if it is long and similar enough."""
    s, e, p, q = int(hit[0]), int(hit[-1]) + 1, int(pos.min()), int(pos.max()) + 1
    if min(e - s, q - p) < LEAST_LENGTH:
        return None
    return (s, e + K - 1, p, q + K - 1) if _similar(y[s:e], x[p:q]) else None


class _Characters:
    """Code points before a byte of one row."""

    def __init__(self, raw: np.ndarray):
        self.count = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])

    def __call__(self, byte: int) -> int:
        return int(self.count[byte])


class _Text:
    """Shingles of a text, and its code points by words."""

    def __init__(self, shingles: np.ndarray, start: np.ndarray, end: np.ndarray, raw: np.ndarray):
        self.shingles, self.start, self.end, self.raw = shingles, start, end, raw
        self.chars: _Characters | None = None

    def place(self, a: int, b: int) -> tuple[int, int]:
        self.chars = self.chars or _Characters(self.raw)
        return self.chars(self.start[a]), self.chars(self.end[b - 1])


def _texts(column: pa.Array) -> Iterator[_Text]:
    hashes, first, start, end = textvec.words(column)
    offsets, raw = textvec.buffers(column)
    for i, shingles in enumerate(textvec.shingles(hashes, first, K)):
        own = slice(first[i], first[i + 1])
        yield _Text(shingles, start[own], end[own], raw[offsets[i] : offsets[i + 1]])


def _covers(span: tuple[int, int, int, int], b_at: int, a_at: int) -> bool:
    """Whether a passage (as _runs gives it) holds the shingles at these places."""
    s, e, p, q = span
    return s <= b_at and b_at + K <= e and p <= a_at and a_at + K <= q


def _matches(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, a_start, a_end, a_word, a_to, b, b_start, b_end, b_word, b_to) of every passage
    that the documents of a pair share, in code points and in words, ends exclusive.
    Pairs may bring `known`, passages around a place (b_at, a_at) that count where the
    comparison of the whole texts shows none."""
    kind = pairs.schema["a"].dataType
    names = [f"{k}{c}" for k in "ab" for c in ("", "_start", "_end", "_word", "_to")]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre: tuple | None = None
        for batch in batches:
            for part in textvec.parts(batch, "text", 200, PART):
                found: list[tuple] = []
                for a, is_centre, b, known, own in zip(*(part.column(c).to_pylist() for c in ("a", "centre", "doc_id", "known")), _texts(part.column("text")), strict=True):
                    if is_centre:
                        centre = a, own
                        continue
                    if centre is None or centre[0] != a:
                        raise RuntimeError("a block has no centre")
                    spans = _runs(centre[1].shingles, own.shingles)
                    for k in known or ():
                        if not any(_covers(span, k["b_at"], k["a_at"]) for span in spans):
                            spans.append((k["s"], k["e"], k["p"], k["q"]))
                    for s, e, p, q in spans:
                        found.append((a, *centre[1].place(p, q), p, q, b, *own.place(s, e), s, e))
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, part.schema.field("doc_id").type if n in "ab" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    # the centre's row, then the others of the block
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    block = F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)).alias("block")
    known = (F.col("known") if "known" in pairs.columns else F.lit(None)).cast(KNOWN).alias("known")
    laid = pairs.join(bounded(many), "a", "left").select("a", "b", block, known)
    centres = laid.select("a", "block").distinct().select("a", "block", F.lit(True), F.col("a"), F.lit(None).cast(KNOWN))
    roles = laid.select("a", "block", F.lit(False).alias("centre"), F.col("b").alias("doc_id"), "known").union(centres)
    rows = docs.join(bounded(roles), "doc_id").select("a", "block", "centre", "doc_id", "text", "known")
    sorted_ = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.desc("centre"), "doc_id")
    return sorted_.mapInArrow(run, ", ".join(f"{n} {kind.simpleString() if n in 'ab' else 'long'}" for n in names))


def _keys_left(left: DataFrame) -> DataFrame:
    """(key, doc_id, at, centre): the keys of several documents; the smallest is a centre."""
    own = Window.partitionBy("key")
    sizes = left.select("key", "doc_id", "at", F.min("doc_id").over(own).alias("least"), F.max("doc_id").over(own).alias("most"))
    return sizes.where("least <> most").select("key", "doc_id", "at", (F.col("doc_id") == F.col("least")).alias("centre"))


def _met(named: DataFrame) -> DataFrame:
    """(a, b, key), a < b: centres with the documents of their keys."""
    other = named.where("centre").select("key", F.col("doc_id").alias("other")).distinct()
    return named.join(other, "key").where("doc_id <> other").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"), "key")


def _closest(named: DataFrame) -> DataFrame:
    """(a, b): for each document the centre that shares most of its keys."""
    shared = _met(named).groupBy("a", "b").agg(F.count("*").alias("n"))
    return shared.groupBy("b").agg(F.max(F.struct("n", "a")).alias("most")).select("most.a", "b")


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `linked`, the places (a, place) of smaller documents that passages bring
    theirs to; only keys whose places aren't all seen to be linked."""
    spans = found.groupBy(F.col("b").alias("doc_id")).agg(
        F.collect_set(F.struct(F.col("b_word").alias("lo"), F.col("b_to").alias("hi"), "a", F.col("a_word").alias("p"), F.col("a_to").alias("q"))).alias("spans")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    places = F.expr(
        f"array_distinct(transform(filter(spans, s -> at >= s.lo and at + {K} <= s.hi), s -> struct(s.a as a, cast(s.p + (at - s.lo) * (s.q - s.p) / (s.hi - s.lo) as int) as place)))"
    )
    named = rows.join(spans, "doc_id", "left").withColumn("linked", F.coalesce(places, F.array().cast(f"array<struct<a: {kind}, place: int>>"))).drop("spans")
    label = F.coalesce(F.array_min("linked"), F.struct(F.col("doc_id").alias("a"), F.col("at").cast("int").alias("place")))
    open_ = named.groupBy("key").agg(F.min(label).alias("low"), F.max(label).alias("high")).where(f"low.a <> high.a or high.place - low.place > {DRIFT}")
    return named.join(open_.select("key"), "key")


def _surroundings(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """key, doc_id, at, lo, around, linked: the shingles (32 bits of each) of all paragraphs
    that can hold the key at this place, the first of them at `lo`; of a document's places
    with equal ones, one."""

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textvec.parts(batch, "text", 200, PART):
                own = part.column("own")
                flat, ends = own.flatten(), np.cumsum(np.asarray(pc.list_value_length(own)))
                keys, ats = np.asarray(flat.field("key")), np.asarray(flat.field("at"))
                held: list[tuple] = []

                def out() -> pa.RecordBatch:
                    i, row, at, lo, near = zip(*held, strict=True)
                    held.clear()
                    i = pa.array(i)
                    columns = [flat.field("key").take(i), part.column("doc_id").take(pa.array(row)), pa.array(at, pa.int32()), pa.array(lo, pa.int32()), pa.array(near, pa.binary()), flat.field("linked").take(i)]
                    return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "at", "lo", "around", "linked"])

                for row, (hi, text) in enumerate(zip(ends.tolist(), _texts(part.column("text")), strict=True)):
                    sh, seen = (text.shingles >> np.uint64(32)).astype("<u4"), set()
                    for i in range(int(ends[row - 1]) if row else 0, hi):
                        first = min(max(int(ats[i]) - AROUND, 0), sh.size - 2 * AROUND - 1)
                        lo = max(0, first - WINDOW + 1)
                        near = sh[lo : first + 2 * AROUND + WINDOW].tobytes()
                        same = int(keys[i]), first - lo, near
                        if len(near) >= 4 * LEAST_LENGTH and same not in seen:
                            seen.add(same)
                            held.append((i, row, first + AROUND, lo, near))
                    if len(held) * 8 * WINDOW > PART:
                        yield out()
                if held:
                    yield out()

    kind, linked = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "linked"))
    own = rows.groupBy("doc_id").agg(F.collect_list(F.struct("key", F.col("at").cast("int").alias("at"), "linked")).alias("own"))
    texts = texts_of(docs, own.select("doc_id")).join(own, "doc_id").select("doc_id", "text", "own")
    return texts.mapInArrow(run, f"key long, doc_id {kind}, at int, lo int, around binary, linked {linked}")


class _Chains:
    """Places of a key, joined where a passage links them."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, x: int) -> int:
        while (y := self.above[x]) != x:
            self.above[x] = self.above[y]
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _around_key(cost: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row the least sum of costs over the stretches that hold the key and are as
    long as a passage."""
    value = np.zeros((cost.shape[0], cost.shape[1] + 1), np.float32)
    np.cumsum(cost, axis=1, out=value[:, 1:])
    end = np.arange(LEAST_LENGTH, cost.shape[1] + 1)
    start = np.minimum(key[:, None], end[None, :] - LEAST_LENGTH)
    best = value[:, LEAST_LENGTH:] - np.take_along_axis(np.maximum.accumulate(value, axis=1), start, axis=1)
    best[(end[None, :] <= key[:, None]) | (end[None, :] > size[:, None])] = np.inf
    return best.min(axis=1, initial=np.inf)


def _straight(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end column of the passage around the column AHEAD in each row of hits, both
    0 if there is none: what _runs gives for two texts without repeats, all of whose
    common shingles stand at equal distance from the key."""
    col, wide = np.arange(hit.shape[1], dtype=np.int32), hit.shape[1]
    before = np.zeros((hit.shape[0], wide + 1), np.int32)
    np.cumsum(hit, axis=1, out=before[:, 1:])
    last = np.maximum.accumulate(np.where(hit, col, -wide), axis=1)
    gap = np.zeros(hit.shape, np.int32)
    gap[:, 1:] = col[1:] - last[:, :-1]
    gap[:, 0] = wide
    gap[~hit] = 0
    far = gap > GAP
    first = np.where(far[:, : AHEAD + 1], col[: AHEAD + 1], 0).max(axis=1)
    to = np.where(far[:, AHEAD + 1 :], col[AHEAD + 1 :], wide).min(axis=1)
    end = last[np.arange(to.size), to - 1] + 1
    todo = np.flatnonzero(hit[:, AHEAD])
    found = np.zeros(to.size, bool)
    while todo.size:
        size, shared = end[todo] - first[todo], before[todo, end[todo]] - before[todo, first[todo]]
        fits = size >= LEAST_LENGTH
        good = fits & (100 * shared >= PERCENT * (2 * size - shared))
        found[todo[good]] = True
        todo, shared = todo[fits & ~good], shared[fits & ~good]
        if todo.size:  # too much was edited: cut at the widest gap, of equal ones at the middle one
            s, e = first[todo, None], end[todo, None]
            space = np.where((col > s) & (col < e), gap[todo], 0)
            rank = before[todo, :-1] - before[todo, first[todo]][:, None] - 1
            off = np.where(space == space.max(axis=1, keepdims=True), np.abs(rank - ((shared - 1) // 2)[:, None]), wide)
            cut = off.argmin(axis=1)
            low = cut <= AHEAD
            first[todo[low]] = cut[low]
            end[todo[~low]] = (cut - space[np.arange(cut.size), cut] + 1)[~low]
    return np.where(found, first, 0), np.where(found, end, 0)


def _exact(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end column of the run of hits around the column AHEAD in each row."""
    col = np.arange(hit.shape[1])
    first = np.where(hit[:, : AHEAD + 1], -1, col[: AHEAD + 1]).max(axis=1) + 1
    return first, np.where(hit[:, AHEAD:], hit.shape[1], col[AHEAD:]).min(axis=1)


def _bucket(docs: list, at: list[int], lo: list[int], around: list[bytes], linked: list[tuple]) -> list[tuple]:
    """(a, b, s, e, p, q, b_at, a_at) of a key: passages around it, s to e of b and p to q of
    a, that link the places which no chain of passages links yet.  `linked` has (a, place,
    the row's number)."""
    chains, out = _Chains(len(docs)), []
    places = sorted(linked + list(zip(docs, at, range(len(docs)), strict=True)))
    doc, place, one = places[0]
    for d, k, i in places[1:]:
        if d == doc and k - place <= DRIFT:
            chains.join(one, i)
        else:
            doc, place, one = d, k, i

    def add(i: int, j: int, span: tuple[int, int, int, int]) -> None:  # span: of j, then of i
        s, e, p, q = span[0] + lo[j], span[1] + lo[j], span[2] + lo[i], span[3] + lo[i]
        out.append((docs[i], docs[j], s, e, p, q, at[j], at[i]) if docs[i] < docs[j] else (docs[j], docs[i], p, q, s, e, at[i], at[j]))

    members: dict[tuple, list[int]] = {}
    for i, (k, l, near) in enumerate(zip(at, lo, around, strict=True)):
        members.setdefault((k - l, near), []).append(i)
    for (_, near), (i, *others) in members.items():
        whole = len(near) // 4 + K - 1
        for j in others:
            if chains.join(i, j):
                add(i, j, (0, whole, 0, whole))
    rows = list(members.values())
    rep = [x[0] for x in rows]
    group = np.array([chains.root(i) for i in rep])
    if (group == group[0]).all():
        return out
    key = np.array([at[i] - lo[i] for i in rep])
    size = np.array([len(around[i]) // 4 for i in rep])
    owner = {d: i for i, d in enumerate(dict.fromkeys(docs))}
    sole = np.array([owner[docs[x[0]]] if len(x) == 1 or len({docs[i] for i in x}) == 1 else -1 - n for n, x in enumerate(rows)])
    words, flat = np.unique(np.frombuffer(b"".join(around[i] for i in rep), "<u4"), return_inverse=True)
    wide = int(size.max())
    held = np.arange(wide)[None, :] < size[:, None]
    which = np.full(held.shape, words.size, np.int32)
    which[held] = flat
    order = np.argsort(which, axis=1, kind="stable")
    ranked = np.take_along_axis(which, order, axis=1)
    new = np.ones(held.shape, bool)
    np.put_along_axis(new, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], axis=1)
    repeats = (held & ~new).any(axis=1)
    least = _distinct_least(order, ranked, size)
    # the rows with their keys in one column
    beside = np.full((len(rep), 2 * AHEAD + 1), -1, np.int32)
    column = np.arange(wide)[None, :] + AHEAD - key[:, None]
    beside[np.nonzero(held)[0], column[held]] = flat
    # for each word the rows that hold it; those in all rows tell nothing
    row_of, word_of = np.nonzero(held & new)[0], which[held & new]
    post = row_of[np.argsort(word_of, kind="stable")]
    many = np.bincount(word_of, minlength=words.size)
    begin, everywhere = np.cumsum(many) - many, many == len(rep)
    tested, mark, spot = np.zeros(len(rep), bool), np.zeros(words.size + 1, np.uint8), np.full(words.size + 1, wide)
    while True:
        names, count = np.unique(group, return_counts=True)
        todo = np.flatnonzero((group != names[count.argmax()]) & ~tested)
        if names.size == 1 or not todo.size:  # of two chains one isn't the largest
            return out
        c = int(todo[0])
        own, n = which[c, : size[c]], int(size[c])
        tested[c] = True
        once, place = np.unique(own, return_inverse=True)
        lists = [post[k : k + m] for k, m in zip(begin[once].tolist(), np.where(everywhere, 0, many)[once].tolist(), strict=True) if m]
        shared = np.bincount(np.concatenate(lists), minlength=len(rep)) if lists else np.zeros(len(rep), np.int64)
        shared += everywhere[once].sum()
        other = np.flatnonzero((7 * shared >= 3 * (least + least[c])) & (group != group[c]) & (sole != sole[c]))
        if not other.size:
            continue

        def join(j: int, span: tuple[int, int, int, int] | None) -> None:
            if span and (pair := next(((x, y) for x in rows[c] for y in rows[j] if docs[x] != docs[y]), None)):
                add(*pair, span)
                group[group == group[j]] = group[c]

        # all that are shared side by side need no search, nor does an exact passage
        hit = (beside[other] == beside[c]) & (beside[c] >= 0)
        again, here = repeats[other] | repeats[c], hit.sum(axis=1)
        plain = ~again & (here == shared[other]) & hit[:, AHEAD]
        (s, e), to_search = _exact(hit), []
        first, end = np.where(e - s >= LEAST_LENGTH, s, 0), np.where(e - s >= LEAST_LENGTH, e, 0)
        first[plain], end[plain] = _straight(hit[plain])
        for i in np.argsort(-here, kind="stable").tolist():
            j, s, e = int(other[i]), int(first[i]), int(end[i]) + K - 1
            if end[i] and group[j] != group[c]:
                y, x = int(key[j]) - AHEAD, int(key[c]) - AHEAD
                join(j, (s + y, e + y, s + x, e + x))
        open_ = (end == 0) & ~plain & (group[other] != group[c])
        if not open_.any():
            continue
        other, again = other[open_], again[open_]
        mark[own] = 1
        hit, shared = mark[which[other]], shared[other]
        mark[own] = 0
        # what is lost of both texts is a third of what they share at most: n - 7/6 h of n
        # shingles and h hits sum to 0 at most; shingles that repeat count once, where they are new
        spot[once] = np.arange(once.size)
        seen = np.zeros((other.size, wide + 1), np.uint8)
        seen[np.arange(other.size)[:, None], spot[which[other]]] = 1
        spot[once] = wide
        seen = seen[:, place]
        lost = np.where(again, -shared / 3, 0)
        for h, fresh, at_, size_ in ((hit, new[other], key[other], size[other]), (seen, new[c : c + 1, :n], np.full(other.size, key[c]), np.full(other.size, n))):
            lost += _around_key(np.where(again[:, None], fresh & (h == 0), 1 - h * np.float32(7 / 6)), at_, size_)
        for j, worth, twice in sorted(zip(other.tolist(), lost.tolist(), again.tolist(), strict=True), key=lambda x: x[1]):
            if worth > 1e-3:
                break
            if group[j] != group[c]:
                join(j, (_passage_along if twice else _passage_at)(own, which[j, : size[j]], int(key[c]), int(key[j])))


def _distinct_least(order: np.ndarray, ranked: np.ndarray, size: np.ndarray) -> np.ndarray:
    """At least so many distinct shingles has a passage of each row, sorted as `ranked`."""
    out = np.full(size.size, LEAST_LENGTH)
    row, at = np.nonzero((ranked[:, 1:] == ranked[:, :-1]) & (np.arange(1, order.shape[1])[None, :] < size[:, None]))
    if row.size:  # one isn't new in the stretches that hold the one before it
        now, before = order[row, at + 1], order[row, at]
        near = now - before < LEAST_LENGTH
        row, now, before = row[near], now[near], before[near]
        some, row = np.unique(row, return_inverse=True)
        again = np.zeros((some.size, order.shape[1] + 1), np.int64)
        np.add.at(again, (row, np.maximum(now - LEAST_LENGTH + 1, 0)), 1)
        np.add.at(again, (row, before + 1), -1)
        again = np.cumsum(again, axis=1)
        again[np.arange(again.shape[1])[None, :] + LEAST_LENGTH > size[some, None]] = 0
        out[some] -= again.max(axis=1, initial=0)
    return out


def _passage_at(x: np.ndarray, y: np.ndarray, x_at: int, y_at: int) -> tuple[int, int, int, int] | None:
    """A passage of y and x that holds these places."""
    return next((span for span in _runs(x, y) if _covers(span, y_at, x_at)), None)


def _passage_along(x: np.ndarray, y: np.ndarray, x_at: int, y_at: int) -> tuple[int, int, int, int] | None:
    """A passage of y and x that brings these places together, of texts that repeat
    themselves; one that brings others together is found at those."""
    seg = _segments(x, y)
    seg = seg[np.lexsort((seg[:, 2], seg[:, 1]))]
    seed = np.flatnonzero((seg[:, 0] == x_at - y_at) & (seg[:, 1] <= y_at) & (y_at < seg[:, 2]))
    if not seed.size:
        return None
    chain = seg[_chain(seg, int(seed[0]))]
    if chain[:, 2].max() - chain[:, 1].min() < LEAST_LENGTH:
        return None
    return next((span for span in _cut(x, y, chain) if _covers(span, y_at, x_at)), None)


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b, known), a < b: what _bucket gives for each key."""
    names = ["a", "b", "s", "e", "p", "q", "b_at", "a_at"]

    @settled
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            key = np.asarray(table.column("key"))
            own = [table.column(c).to_pylist() for c in ("doc_id", "at", "lo", "around")]
            links = pa.chunked_array(table.column("linked")).combine_chunks()
            count = np.asarray(pc.fill_null(pc.list_value_length(links), 0))
            flat, till, row = links.flatten(), np.append(0, np.cumsum(count)), np.repeat(np.arange(count.size), count).tolist()
            a, place = flat.field("a").to_pylist(), flat.field("place").to_pylist()
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, key.size).tolist()
            found: list[tuple] = []
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if hi - lo > 1:
                    found += _bucket(*(c[lo:hi] for c in own), [(a[i], place[i], row[i] - lo) for i in range(till[lo], till[hi])])
            columns, kind = list(zip(*found, strict=True)) or [()] * len(names), table.schema.field("doc_id").type
            return pa.RecordBatch.from_arrays([pa.array(c, kind if n in "ab" else pa.int32()) for n, c in zip(names, columns, strict=True)], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("key"))
            cut = int(np.searchsorted(key, key[-1]))  # where the last key begins
            if cut or held and held[-1].column("key")[0].as_py() != key[0]:
                yield out(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield out(pa.Table.from_batches(held))

    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartition("key").sortWithinPartitions("key", "doc_id", "at")
    pairs = dealt.mapInArrow(run, ", ".join(f"{n} {kind if n in 'ab' else 'int'}" for n in names))
    return pairs.groupBy("a", "b").agg(F.collect_set(F.struct(*names[2:])).alias("known"))


def shared_passages(docs: DataFrame, work: Work) -> DataFrame:
    """What _matches gives for all pairs that are compared; docs (doc_id, text) have one
    row for each id."""
    named = work.table(_keys_left(paragraph_keys(docs)), "keys")
    found = work.table(_matches(work.table(_closest(named), "pairs-0"), docs), "matches-0")
    left = work.table(_open(named.drop("centre"), found), "open")
    work.drop("keys")
    pairs = work.table(_candidates(_surroundings(left, docs)), "pairs-1")
    work.drop("open")
    return found.union(work.table(_matches(pairs, docs), "matches-1"))


def repeated_passages(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """doc_id, start, end (code points), n_words, component_doc, component_start and
    removed, one row for each passage that occurs in more than one document."""
    work = work or Work(docs.sparkSession, "substring")
    found = shared_passages(one_text(docs, work), work)
    a, b = (F.struct(F.col(k).alias("doc_id"), F.col(f"{k}_start").alias("start"), F.col(f"{k}_end").alias("end")) for k in "ab")
    comp = components(found.select(a.alias("a"), b.alias("b")), work)
    words = found.select(b.alias("node"), (F.col("b_to") - F.col("b_word")).alias("n_words")).union(found.select(a.alias("node"), F.col("a_to") - F.col("a_word"))).groupBy("node").agg(F.max("n_words").alias("n_words"))
    return comp.distinct().join(words, "node", "left").select(
        "node.*", "n_words", F.col("component.doc_id").alias("component_doc"), F.col("component.start").alias("component_start"), (F.col("node") != F.col("component")).alias("removed")
    )


def without_repeats(docs: DataFrame, work: Work | None = None) -> DataFrame:
    """docs with the removed passages cut from `text` (and `n_chars` recounted); a
    document without any stays as it is.  Different texts of one id are documents of
    their own here."""
    work = work or Work(docs.sparkSession, "substring")
    docs, names = versions(docs, work), docs.columns
    spans = repeated_passages(docs.select(F.col(OWN).alias("doc_id"), "text"), work).where("removed").groupBy(F.col("doc_id").alias(ID)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(CUT))
    cut = F.expr(
        f"aggregate({CUT}, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.end), 'out',"
        " if(x.start > s.at, concat(s.out, substring(text, cast(s.at as int) + 1, cast(x.start - s.at as int))), s.out)),"
        " s -> concat(s.out, substring(text, cast(s.at as int) + 1)))"
    )
    out = docs.join(spans, F.col(OWN) == F.col(ID), "left").withColumn("text", F.when(F.col(CUT).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(CUT).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


#: Runs of equal words at different places of two texts are not set algebra; the test
#: compares with a plain search over all pairs.
QUERY, ORACLE = ("op7_substring", op7_substring), None
