"""Tokenised documents packed into sequences by best-fit decreasing."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.chunked import ChunkCache, encode_slice, slices
from quire.llm.common import written

#: Rows that one packing task sorts and packs, about. What is lost is a few part-filled sequences for each of so many rows.
PACK_ROWS = 32_000

# The normal form and the splitting of the vocabulary files that are encoded chunk by chunk.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
# Chunks of printable ASCII, white space and the letters of Latin-1: lower-casing and normal form are plain there.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ\s]+")


def _byte_characters() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Encodes text chunk by chunk where the file splits words at white space and drops that (by_chunks), else whole texts by the library alone."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(self.tokenizer.to_str())
        self.by_chunks = (parts["normalizer"], parts["pre_tokenizer"], parts["model"].get("dropout")) == (_NORMAL, _SPLIT, None)
        self.model = self.tokenizer.model
        self.byte = _byte_characters()
        self.word = ChunkCache(self._word)
        self.chunk = ChunkCache(self._chunk)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(self.byte[b] for b in word.encode())
        return array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, flat ids)."""
        if self.by_chunks:
            return encode_slice(texts, self.chunk)
        found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
        return np.cumsum([0, *map(len, found)]), np.array([i for f in found for i in f], np.int32)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return b"".join(map(self.word, _PARTS.findall(chunk.lower())))
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.int32).tobytes()


@lru_cache(2)
def word_tokenizer(file: str) -> WordTokenizer:
    return WordTokenizer(file)


def token_pieces(df: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece (from 0), start, length, ids (little-endian unsigned 32-bit).

    A document is its ids, then end_id; only a longer one than capacity is cut, into pieces of capacity
    tokens, the last of which may be shorter. Null and empty texts give one piece of one token.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_file)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                upto, ids = tokenizer.slice(part)
                keys, piece, start, body = [], [], [], []
                for i, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], np.int32(end_id)).astype("<u4")
                    for n, s in enumerate(range(0, len(own), capacity)):
                        keys.append(at + i)
                        piece.append(n)
                        start.append(s)
                        body.append(own[s : s + capacity].tobytes())
                at += len(part)
                sizes = pa.array([len(x) // 4 for x in body], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), sizes, pa.array(body, pa.binary())], [key, "piece", "start", "length", "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids binary")


class OpenBins:
    """A segment tree over remaining capacities: how many open bins each subtree holds. The tightest fit is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        node = remaining + self.width
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, bin_: int, remaining: int) -> None:
        self.bins[remaining].append(bin_)
        self._add(remaining, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its remaining capacity), the least that holds size; of equals the one opened or filled last."""
        tree, node = self.tree, size + self.width
        if not tree[node]:
            while not (node & 1 == 0 and tree[node + 1]):
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.width:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        remaining = node - self.width
        self._add(remaining, -1)
        return self.bins[remaining].pop(), remaining


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. sizes: from 1 to capacity, descending."""
    bins, offsets, opened, open_ = [], [], 0, OpenBins(capacity)
    for size in sizes.tolist():
        found = open_.take(size) if size < capacity else None
        if found is None:
            found, opened = (opened, capacity), opened + 1
        bin_, remaining = found
        bins.append(bin_)
        offsets.append(capacity - remaining)
        if remaining > size:
            open_.put(bin_, remaining - size)
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def best_fit_pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """pieces with sequence_id and offset (columns of these names are replaced): sequences of at most capacity, filled without gaps.

    Rows are dealt by a hash of their keys into groups of about PACK_ROWS, each packed by itself, so no
    task's work grows with the input and no key can make a group large. Repeated rows are items of their
    own. Lengths must be from 1 to capacity. An empty table gives no rows. pieces is read twice.
    """
    groups = -(-pieces.count() // PACK_ROWS) or 1
    dealt = pieces.drop("sequence_id", "offset").withColumn("__group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    names = [f.name for f in dealt.schema if f.name != "__group"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "__group")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(length, "descending"), *((k, "ascending") for k in keys)])
        bins, offsets = best_fit_decreasing(np.asarray(table[length]), capacity)
        ids = bins + (int(table["__group"][0].as_py()) << 40)
        return table.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("__group").applyInArrow(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_file: str, capacity: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of df's documents without their ids but with ids_crc32, packed."""
    pieces = token_pieces(df, tokenizer_file, capacity, text=text, key=key)
    kept = written(pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return best_fit_pack(kept, capacity, (key, "piece"))
