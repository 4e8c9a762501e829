"""Byte-level BPE: encoding with offsets, and decoding, over Arrow batches.

The tokenizers library runs a model built from a ranks file: every split of a token
into two tokens is a merge, in the order of the ranks, so the merges are those that
the ranks alone define.  Equal chunks of text are encoded once (see chunks).  The
byte table maps each byte to the character that stands for it in the model; decoding
reverses it.  A character whose bytes lie in two tokens is within both tokens'
offsets, and comes back whole once the bytes are joined.

Null counts as empty; an empty text has no ids.  Special tokens don't exist: their
names in a text are ordinary text.  Repeated rows and other columns have no influence.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keylode.llm.chunks import _CONTROL, Table, with_space
from keylode.llm.work import read

#: Texts that are encoded together hold about this many characters.
TOGETHER = 1 << 19


def _byte_table() -> list[str]:
    """The character for each byte: itself where it is printable Latin-1, else one
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Codec:
    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        table = _byte_table()
        name = lambda token: "".join(table[b] for b in token)
        order = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
        merges = [(name(t[:i]), name(t[i:])) for t in order for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, merges))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table = Table(self._encode)
        back = {c: b for b, c in enumerate(table)}
        vocabulary = self.model.get_vocab()
        size = max(vocabulary.values()) + 1
        tokens = [b""] * size
        for t, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in t)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Chunks from white space to another character are encoded end to end, many
        at a time; the lengths of the tokens tell where each ends."""
        joined = [i for i, c in enumerate(chunks) if c[0].isspace() and not c[-1].isspace() and not _CONTROL.search(c)]
        out = [b""] * len(chunks)
        for i in set(range(len(chunks))).difference(joined):
            out[i] = self._ids(chunks[i])
        for i in range(0, len(joined), 2000):
            some = joined[i : i + 2000]
            ids = self._ids("".join(chunks[j] for j in some))
            ends = np.cumsum(self.length[np.frombuffer(ids, "<u4")])
            stops = np.searchsorted(ends, np.cumsum([len(chunks[j].encode()) for j in some])) * 4 + 4
            for j, x, y in zip(some, np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True):
                out[j] = ids[x:y]
        return out

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.table([with_space(t) for t in texts])

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4")
        size = self.length[at]
        step = np.repeat(self.start[at] - (np.cumsum(size) - size), size)
        return self.flat[step + np.arange(step.size)].tobytes()

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """First and end character of each token."""
        end = np.cumsum(self.length[np.frombuffer(ids, "<u4")])
        begins = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(begins) - 1
        start = np.append(0, end[:-1])[: end.size]
        return np.stack([char[start], char[end - 1] + 1], axis=1) if end.size else np.zeros((0, 2), np.int64)


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(path, pattern)


def together(values: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, some at a time, with the place of the first."""
    texts: list[str] = []
    size = first = 0
    for i, v in enumerate(values):
        texts.append(v.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and, if asked for, offsets (start and end of each token
    in characters, one after the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, texts in together(batch.column(1)):
                ids = own.encode(texts)
                columns = [batch.column(0).slice(first, len(texts)), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if offsets:
                    columns.append(pa.array([own.offsets(t, x).ravel().astype(np.int32) for t, x in zip(texts, ids, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "offsets"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", offsets array<int>" * offsets)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids back to doc_id, text; bytes that make no character become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for first, texts in together(batch.column(1)):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha256(x).hexdigest() for x in ids]),
                        pa.array([sha256(own.decode(x)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERY, ORACLE = ("op10_bpe", op10_bpe), None
