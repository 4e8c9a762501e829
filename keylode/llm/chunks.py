"""Chunks of a text that a pre-tokenizer treats alike wherever they stand.

Pre-tokenizers of byte-level and word BPE never let a piece run from a character that
isn't white space into one that is.  So a text can be cut before each run of white
space, and equal chunks give equal ids: they are encoded once and kept in a bounded
table for the worker's lifetime.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keylode.llm import textvec

#: White_Space of Unicode, as the tokenizers' expressions have it (str.split() differs).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORD = re.compile(f"[^{_SPACE}]+")
#: What keeps a text from the short way below: white space other than single blanks
#: and line ends between other characters.
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_ODD_OTHER = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROL = re.compile("[\x1c-\x1f]")


def _odd(text: str) -> bool:
    return text[-1:] in (" ", "\n") or any(c in text for c in _ODD_ASCII) or not text.isascii() and any(c in text for c in _ODD_OTHER)


def with_space(text: str) -> list[str]:
    """Chunks, each with the white space before it; joined they are the text."""
    if not text:
        return []
    if _odd(text):
        return _CHUNK.findall(text)
    parts = text.replace("\n", " \n").split(" ")
    out = [p if p[:1] == "\n" else " " + p for p in parts]
    if parts[0]:
        out[0] = parts[0]
    else:
        del out[0]
    return out


def without_space(text: str) -> list[str]:
    """The runs of other characters."""
    return _WORD.findall(text) if _CONTROL.search(text) else text.split()


class Table:
    """Ids of chunks as little-endian unsigned 32-bit bytes.

    The table has two generations of at most `most` chunks: when the newer is full it
    becomes the older, and what is used again moves back, so frequent chunks stay."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 350_000):
        self.encode, self.most = encode, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given by its chunks."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.older, self.known = self.known, {}
            new = set().union(*texts)
        known, older = self.known, self.older
        if len(new) > self.most:  # a text of more chunks than the table may hold
            return [b"".join(b"".join(self.encode(t[i : i + 10_000])) for i in range(0, len(t), 10_000)) for t in texts]
        todo = []
        for chunk in new:
            if chunk in older:
                known[chunk] = older[chunk]
            else:
                todo.append(chunk)
        for i in range(0, len(todo), 10_000):
            known.update(zip(todo[i : i + 10_000], self.encode(todo[i : i + 10_000]), strict=True))
        return [b"".join(map(known.__getitem__, t)) for t in texts]


# How the tokenizer file must cut words for the short way below to hold.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CASELESS = ["NFC", "Replace", "Lowercase"]
#: Words of these characters keep their ids in lower case (no "<", so no special token).
_LATIN = "^[!-;=-~\u00c0-\u00ff]+$"
#: A last letter or digit, and marks after it: the marks are a piece of their own.
_CORE = "^(?P<core>[!-;=-~\u00df-\u00ff]*[a-z0-9\u00df-\u00f6\u00f8-\u00ff])(?P<tail>[!-&(-/:;=-@\\[-`{-~]*)$"
_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] of the entries `which`, end to end."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if ends.size else 0) + np.repeat(start[which] - (ends - n), n)]


#: Bytes of the texts whose words are numbered together.
SLICE = 1 << 22


class Words:
    """Ids of texts under a tokenizer that drops white space, by their distinct words.

    Arrow cuts and numbers the words of many texts at once; each distinct word is
    encoded once and kept in a table, which starts anew when it holds `most` words.  Where the tokenizer ignores case and cuts off marks, words of Latin letters
    are kept as their lower-case core and the marks after it, and cores of letters
    alone (one piece each) are encoded many at a time."""

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model, self.most = Tokenizer.from_file(path), most
        with open(path) as file:
            spec = json.load(file)
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        mark = spec["model"].get("end_of_word_suffix")
        self.plain = steps == _CASELESS and cuts[:1] == [_CUTS] and bool(mark)
        names = self.model.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        if self.plain:
            self.last[[i for t, i in names.items() if t.endswith(mark)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: list[str], letters: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sizes and ids of words, some at a time."""
        for i in range(0, len(words), 10_000):
            some = words[i : i + 10_000]
            if letters:
                ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
                if size.size != len(some):
                    raise RuntimeError("words and their last pieces differ in number")
            else:
                own = [e.ids for e in self.model.encode_batch_fast(some, add_special_tokens=False)]
                size, ids = np.array([len(x) for x in own], np.int64), np.array([t for x in own for t in x], np.uint32)
            yield size, ids

    def _slots(self, column: pa.Array) -> np.ndarray:
        """The place in the table of each word; those that it hasn't are put in."""
        words = column.to_pylist()
        found = np.array([self.known.get(w, -1) for w in words], np.int64)
        letters = np.asarray(pc.match_substring_regex(column, _LETTERS)) if self.plain else np.zeros(len(words), bool)
        for kind in (True, False):
            new = np.flatnonzero((found < 0) & (letters == kind))
            if not new.size:
                continue
            own = [words[i] for i in new.tolist()]
            sizes, ids = zip(*self._encode(own, kind), strict=True)
            found[new] = np.arange(self.size.size, self.size.size + new.size)
            self.known.update(zip(own, found[new].tolist(), strict=True))
            size = np.concatenate(sizes)
            self.start = np.concatenate([self.start, self.flat.size + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *ids])
        return found

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each word's core and of the marks after it."""
        if len(self.known) > self.most:
            self._clear()
        cores, tails = words, pa.array(np.zeros(len(words), np.int64))
        if self.plain:
            cut = pc.extract_regex(pc.utf8_lower(words), _CORE)
            fit = pc.and_(pc.match_substring_regex(words, _LATIN), pc.is_valid(cut))
            cores = pc.if_else(fit, pc.struct_field(cut, "core"), words)
            tails = pc.if_else(fit, pc.struct_field(cut, "tail"), "").dictionary_encode()
            tails = self._slots(tails.dictionary)[np.asarray(tails.indices)]
        cores = cores.dictionary_encode()
        return self._slots(cores.dictionary)[np.asarray(cores.indices)], np.asarray(tails)

    def __call__(self, texts: pa.Array, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, sizes and ids, end to end, of some texts at a time; `end` is put
        after each text's ids."""
        offsets, raw = textvec.buffers(texts)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        first = 0
        while first < len(texts):
            to = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
            some, own = texts.slice(first, to - first), raw[offsets[first] : offsets[to]]
            if ((own >= 0x1C) & (own <= 0x1F)).any():  # Arrow takes these for white space, tokenizers don't
                split = pa.array([without_space(t) for t in some.to_pylist()], pa.large_list(pa.large_string()))
            else:
                split = pc.utf8_split_whitespace(some)
            stops = np.asarray(split.value_lengths(), dtype=np.int64).cumsum()
            words = split.flatten().dictionary_encode()
            core, tail = self._parts(words.dictionary)
            size = self.size[core] + self.size[tail]
            flat = np.append(gathered(self.flat, self.start, self.size, np.stack([core, tail], axis=1).ravel()), np.uint32(end))
            start, size = np.append(np.cumsum(size) - size, flat.size - 1), np.append(size, 1)
            which = np.insert(np.asarray(words.indices, dtype=np.int64), stops, size.size - 1)
            stops += np.arange(1, stops.size + 1)
            ids = np.concatenate([gathered(flat, start, size, which[i : i + 250_000]) for i in range(0, which.size, 250_000)])
            yield first, np.diff(np.concatenate([[0], np.cumsum(size[which])])[np.append(0, stops)]), ids
            first = to
