"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is first split at safe boundaries: before a single space whose neighbours are not white space.
The pattern's matches never reach over such a place, whatever surrounds it, so the ids of the pieces
put together are the ids of the text; and each distinct piece of a batch is encoded once. Texts with
other white space next to a space are split at letter-space-letter only, and pieces that are still
long are matched in Python, as the library's own matcher overflows on very long runs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.chunked import ChunkCache, encode_slice, slices

LONG = 20_000
_SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_IRREGULAR = r"(?: [\s\v\p{Z}\x{1c}-\x{1f}\x{85}])|(?:[\s\v\p{Z}\x{1c}-\x{1f}\x{85}] )"


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.spaced = ChunkCache(lambda x: self.encode(" " + x))

    def encode(self, text: str) -> bytes:
        """The ids of a text of any kind and length, as bytes of int32."""
        return np.array(self.ids(text), np.int32).tobytes()

    def ids(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        at = 0
        while at < len(text):
            cut = _SAFE.search(text, at + LONG) if at + LONG < len(text) else None
            piece = text[at : cut.start() if cut else len(text)]
            at += len(piece)
            if len(piece) <= 3 * LONG:
                out += self.encoding.encode_ordinary(piece)
            else:
                for m in self.pattern.finditer(piece):
                    out += self.encoding._core_bpe.encode_single_piece(m.group().encode())
        return out

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in slices(texts):
            odd = np.asarray(pc.match_substring_regex(part, _IRREGULAR))
            if odd.any():
                for i in range(len(part)):
                    if odd[i]:
                        ids = np.array(self.ids(part[i].as_py()), np.int32)
                        yield np.array([0, len(ids)]), ids
                    elif i == 0 or odd[i - 1]:
                        run = int(np.argmax(odd[i:])) or len(part) - i
                        yield encode_slice(part.slice(i, run), self.spaced, self.encode)
            else:
                yield encode_slice(part, self.spaced, self.encode)


@lru_cache(2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    offsets, base = [np.zeros(1, np.int64)], 0
    for upto, ids in parts:
        offsets.append(upto[1:] + base)
        base += len(ids)
    flat = np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(flat, pa.int32()))


def bpe_encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>); a column of that name is replaced. Null texts count as empty; no special tokens.

    rank_file: path of a tiktoken rank file on every machine.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return _lists(list(codec(rank_file, pattern).batch(texts)))

    return df.withColumn(out, encode(F.col(text)))


def bpe_decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the raw bytes of the ids (binary: ids need not end at a character's end). Null ids count as none; unknown ids raise."""

    @F.arrow_udf(T.BinaryType())
    def decode(lists: pa.Array) -> pa.Array:
        enc = codec(rank_file, pattern).encoding
        return pa.array((enc.decode_bytes(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists), pa.binary())

    return df.withColumn(out, decode(F.col(ids)))
