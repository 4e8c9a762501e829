"""Keys and values of text lines.

JSON keys are strict: a line has one only if it is a valid JSON object whose first
top-level occurrence of the field is a non-empty string.  Spark's own JSON functions
accept more (numbers, trailing text, single quotes), so an Arrow UDF parses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reject(name: str) -> None:
    raise ValueError(name)


def parse_key(line: bytes | str | None, field: str) -> bytes | None:
    if line is None:
        return None
    text = line if isinstance(line, str) else bytes(line).decode(errors="replace")
    first: dict = {}

    def pairs(found: list[tuple[str, object]]) -> dict:
        out: dict = {}
        for k, v in found:
            out.setdefault(k, v)
        return out

    try:
        first = json.loads(text, object_pairs_hook=pairs, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    value = first.get(field) if isinstance(first, dict) else None
    return value.encode(errors="surrogatepass") if isinstance(value, str) and value else None


def raw_field(line: bytes | str | None, field: str) -> str | None:
    """The text of a top-level field's value as it stands; the last occurrence counts."""
    if line is None:
        return None
    text = line if isinstance(line, str) else bytes(line).decode(errors="replace")
    decoder = json.JSONDecoder(parse_constant=_reject)
    space = " \t\n\r"

    def skip(i: int) -> int:
        while i < len(text) and text[i] in space:
            i += 1
        return i

    found = None
    try:
        i = skip(0)
        if text[i] != "{":
            return None
        i = skip(i + 1)
        while text[i] != "}":
            if text[i] != '"':
                return None
            name, i = decoder.raw_decode(text, i)
            i = skip(i)
            if text[i] != ":":
                return None
            begin = skip(i + 1)
            _, end = decoder.raw_decode(text, begin)
            if name == field:
                found = text[begin:end]
            i = skip(end)
            if text[i] == ",":
                i = skip(i + 1)
                if text[i] == "}":
                    return None
            elif text[i] != "}":
                return None
        return found if skip(i + 1) == len(text) else None
    except (ValueError, IndexError, RecursionError):
        return None


def json_string_key(field: str):
    """A key function for lines: Column to a binary Column, null where there is none."""

    @F.pandas_udf(T.BinaryType())
    def key(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lines:
            yield part.map(lambda x: parse_key(x, field))

    return lambda line: key(F.col(line) if isinstance(line, str) else line)


def json_raw_field(field: str):
    @F.pandas_udf(T.StringType())
    def value(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in lines:
            yield part.map(lambda x: raw_field(x, field))

    return lambda line: value(F.col(line) if isinstance(line, str) else line)


def before_comma(line: Column) -> Column:
    """The key of a CSV line: what stands before the first comma, if anything."""
    text = line.cast("string")
    return F.when(F.instr(text, ",") > 1, F.substring_index(text, ",", 1)).cast("binary")


@dataclass(frozen=True)
class JsonCodec:
    """Typed values as JSON text."""

    schema: T.StructType

    def encode(self, value: Column) -> Column:
        return F.to_json(value)

    def decode(self, raw: Column) -> Column:
        return F.from_json(raw.cast("string"), self.schema, {"mode": "FAILFAST"})


@dataclass(frozen=True)
class JsonLineCodec:
    """Lines of the form {"id":"key","value":...}; the value is put in as it is."""

    field: str = "id"

    def build(self, key: Column, value: Column) -> Column:
        quoted = lambda c: F.to_json(c.cast("variant"))
        return F.concat(F.lit("{"), quoted(F.lit(self.field)), F.lit(":"), quoted(key.cast("string")), F.lit(',"value":'), value.cast("string"), F.lit("}"))

    def build_line(self, key: bytes, value: bytes) -> bytes:
        name, own = (json.dumps(x, ensure_ascii=False) for x in (self.field, key.decode(errors="replace")))
        return f'{{{name}:{own},"value":'.encode() + value + b"}"

    def value(self, line: Column) -> Column:
        return json_raw_field("value")(line)
