"""Payloads that need Python: packed lists, recursive clean-up, completion matches. Arrow batches, never row by row calls."""

from __future__ import annotations

import base64
import gzip
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a plain form of address, any case.
EMAIL = r"(?i)^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"


def valid_email(address: Column, endings: list[str]) -> Column:
    """Whether an address has the plain form and one of the endings (a fixed list of top-level domains)."""
    return F.coalesce(address.rlike(EMAIL) & F.lower(F.substring_index(address, ".", -1)).isin(endings), F.lit(False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unpack_list(blob: pd.Series) -> pd.Series:
    """The JSON elements of a gzipped, base64-coded JSON list; null if it isn't one."""

    def one(b: str | None) -> list[str] | None:
        try:
            found = json.loads(gzip.decompress(base64.b64decode(b)))
        except (TypeError, ValueError, OSError, EOFError):
            return None
        return [json.dumps(x) for x in found] if isinstance(found, list) else None

    return blob.map(one)


@F.pandas_udf(T.StringType())
def pack_list(items: pd.Series) -> pd.Series:
    """An array of JSON texts as one gzipped, base64-coded JSON list; null for null."""
    return items.map(lambda xs: None if xs is None else base64.b64encode(gzip.compress(f"[{','.join(xs)}]".encode(), mtime=0)).decode())


#: Byte-order marks and the encodings they tell, longest first.
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


def decoded(raw: bytes) -> tuple[str, str]:
    """The text of some bytes and the encoding it was told by: a mark, valid UTF-8, else Windows' Latin, which takes all."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), "cp1252"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decoded_text(raw: pd.Series) -> pd.DataFrame:
    """:func:`decoded` of binary values; null for null."""
    return pd.DataFrame([(None, None) if r is None else decoded(bytes(r)) for r in raw], columns=["text", "encoding"])


def _scrub(x: object) -> object:
    if isinstance(x, dict):
        out = {k.lstrip("$"): _scrub(v) for k, v in x.items()}
        return {k: v for k, v in out.items() if k and v is not None}
    return [_scrub(v) for v in x] if isinstance(x, list) else x


@F.pandas_udf(T.StringType())
def scrubbed(text: pd.Series) -> pd.Series:
    """JSON without null members and empty keys, at any depth, and without ``$`` before keys; null if unreadable."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(_scrub(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def match_gain(completion: str, holes: list[tuple[int, int]], before: str, after: str) -> int:
    """Characters of a completion that the line holds beyond the cursor; holes of the completion match anything.

    Of all places where it matches, the one with the largest gain counts; characters in holes and those typed before
    the cursor don't count.
    """
    pieces, at = [], 0
    for a, b in sorted(holes):
        pieces.append(completion[at:a])
        at = b
    pieces.append(completion[at:])
    size = sum(map(len, pieces))
    gains = [size - (len(before) - m.start()) for m in re.finditer(".*".join(map(re.escape, pieces)), before + after) if m.start() <= len(before)]
    return max([0, *gains])


@F.pandas_udf(T.IntegerType())
def completion_gain(completion: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    """:func:`match_gain` of completions without holes; null inputs give null."""
    return pd.Series([None if c is None or b is None or a is None else match_gain(c, [], b, a) for c, b, a in zip(completion, before, after)], dtype="Int32")
