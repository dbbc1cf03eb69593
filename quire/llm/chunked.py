"""Encode texts by their space-separated chunks: each distinct chunk once, then gathered with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; with the cache, it bounds a worker's memory. A longer text is one slice.
SLICE_BYTES = 4 << 20
CACHE_ENTRIES = 100_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in runs of about so many bytes, nulls as empty strings."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a)


class ChunkCache:
    """ids of chunks as bytes of int32, for at most CACHE_ENTRIES chunks."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.seen = encode, {}

    def __call__(self, chunk: str) -> bytes:
        got = self.seen.get(chunk)
        if got is None:
            got = self.encode(chunk)
            if len(chunk) < 64:
                if len(self.seen) >= CACHE_ENTRIES:
                    self.seen.clear()
                self.seen[chunk] = got
        return got


def encode_slice(texts: pa.Array, rest: Callable[[str], bytes], first: Callable[[str], bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the texts, flat int32 ids). first: the encoder of each text's first chunk, if it differs."""
    chunks = pc.split_pattern(texts, " ")
    ends = np.asarray(chunks.offsets).astype(np.int64)
    ends -= ends[0]
    coded = chunks.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    pool = [rest(x) for x in coded.dictionary.to_pylist()]
    if first is not None:
        words = coded.dictionary.take(coded.indices.take(pa.array(ends[:-1]))).to_pylist()
        codes[ends[:-1]] = len(pool) + np.arange(len(words))
        pool += [first(x) for x in words]
    sizes = np.fromiter((len(x) for x in pool), np.int64, len(pool)) // 4
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(pool), np.int32)
    each = sizes[codes]
    upto = np.concatenate(([0], np.cumsum(each)))
    ids = flat[np.repeat(starts[codes] - upto[:-1], each) + np.arange(upto[-1])]
    return upto[ends], ids
