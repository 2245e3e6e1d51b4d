"""Byte-level BPE encoding and decoding with the ranks of a local file.

The tiktoken library does the merges. A rank file is read once on the driver
(under a megabyte) and travels with the tasks, so executors need no copy of it.
Long texts are encoded in parts, cut only where no match of the pattern can reach
across, so the ids are those of the whole text.

NULL and empty texts have no ids. NULL ids decode to NULL. Rows pass through with
all their columns, repeated or not.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.functions import pandas_udf

from .arrow import append_columns

#: Characters of a text that are encoded at once.
PART_CHARS = 1 << 16


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODINGS: dict[tuple[bytes, str], object] = {}


def encoding(ranks: bytes, pattern: str):
    """The tokenizer of a rank file's bytes, built once in each process."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[key]


#: What the pattern's \\s matches, as a character class.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White-space runs from here on are matched here: the library's matcher overflows on them.
_LONG_RUN = 1 << 14


def parts(text: str, size: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """Parts of a text, each with whether it is exactly one match of the pattern.

    A cut before white space that follows something else is safe: every alternative
    that matches something else ends there at the latest, none looks back, and the
    only look-ahead follows white space, with which no such part ends. A very long
    white-space run is one match, less its last character where more text follows.
    A text without a safe place stays whole.
    """
    import regex

    safe = regex.compile(f"(?<!{_SPACE})(?={_SPACE})")
    runs = regex.compile(f"{_SPACE}{{{_LONG_RUN},}}")

    def cut(start: int, stop: int) -> Iterator[tuple[str, bool]]:
        while stop - start > size:
            found = safe.search(text, start + size, stop)
            if not found or found.start() >= stop:
                break
            yield text[start : found.start()], False
            start = found.start()
        if start < stop:
            yield text[start:stop], False

    start = 0
    for run in runs.finditer(text):
        yield from cut(start, run.start())
        start = run.end() - (run.end() < len(text))
        yield text[run.start() : start], True
    yield from cut(start, len(text))


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= _LONG_RUN:
        return np.asarray(enc.encode_ordinary(text), np.int32)
    return np.concatenate([
        np.asarray(enc._encode_single_piece(part) if single else enc.encode_ordinary(part), np.int32)
        for part, single in parts(text)
    ])


def _lists(rows: list[np.ndarray]):
    """The ids of several texts as one Arrow array of lists."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append the ids of the whole text as an array of integers."""
    ranks = read_ranks(path)

    def make():
        enc = encoding(ranks, pattern)
        return lambda texts: [_lists([encode_text(enc, t) for t in texts])]

    return append_columns(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, keep)


def decode(
    df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append the raw bytes behind the ids; they need not be valid UTF-8 for a part."""
    ranks = read_ranks(path)

    def make():
        enc = encoding(ranks, pattern)
        return lambda rows: [[None if r is None else enc.decode_bytes(r) for r in rows]]

    return append_columns(df, [ids], [T.StructField(out, T.BinaryType())], make, keep)


def _sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


@pandas_udf(T.StringType())
def ids_sha256(rows: pd.Series) -> pd.Series:
    """SHA-256 of ids as little-endian unsigned 32-bit integers."""
    return rows.map(_sha256)


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: ids, their number, and digests of the ids and of the decoded bytes.

    One Python step does it all: with one for each of ``encode``, ``decode`` and ``ids_sha256`` a task
    would hold three workers, two of them with a tokenizer, and workers stay with their executor.
    """
    ranks = read_ranks(path)

    def make():
        enc = encoding(ranks, pattern)

        def work(texts):
            rows = [encode_text(enc, t) for t in texts]
            decoded = [hashlib.sha256(enc.decode_bytes(r.tolist())).hexdigest() for r in rows]
            return [list(map(len, rows)), list(map(_sha256, rows)), decoded, _lists(rows)]

        return work

    new = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    ]
    return append_columns(documents, ["text"], new, make, ["doc_id"])
