"""Bloom filters over 64-bit hashes, built by Spark and looked up in Python workers.

A filter has at most MOST_BITS bits (32 MB), so what is sent to the driver and to the executors is bounded. A
filter of more keys than that suits (see suits) passes more rows; it never loses one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 28
_SHIFTS = (0, 19, 38)


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def of(hashes: np.ndarray) -> Bloom:
        """The filter of hashes at hand."""
        bits = min(MOST_BITS, 1 << max(12, (16 * len(hashes)).bit_length()))
        held = np.zeros(bits, bool)
        for shift in _SHIFTS:
            held[(hashes.view(np.uint64) >> np.uint64(shift)) & np.uint64(bits - 1)] = True
        return Bloom(np.packbits(held, bitorder="little").view(np.uint64))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        h, found = hashes.view(np.uint64), True
        for shift in _SHIFTS:
            at = (h >> np.uint64(shift)) & self.mask
            found = found & ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1)
        return found

    def suits(self, count: int) -> bool:
        """Whether so many keys leave at least eight bits for each, with which about one other key in thirty passes."""
        return 8 * count <= 64 * len(self.words)

    def holds(self, hashes: Column) -> Column:
        """True where a hash (long, not null) may be in the filter."""

        @F.arrow_udf("boolean")
        def maybe(h: pa.Array) -> pa.Array:
            return pa.array(self.maybe(np.asarray(h)))

        return maybe(hashes)


def bloom(keys: DataFrame, hashed: str, count: int) -> Bloom:
    """The filter of keys' column of hashes (long), of which there are count."""
    bits = min(MOST_BITS, 1 << max(12, (16 * count).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned(F.col(hashed), s).bitwiseAND(F.lit(bits - 1)) for s in _SHIFTS)))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got["word"])] = np.asarray(got["bits"]).view(np.uint64)
    return Bloom(out)


#: Keys of at most so many bytes, with 32 more for each, are broadcast to be left out.
SMALL_BYTES = 8 << 20


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is not in dropped (one column of that name); rows without a key stay.

    Few keys are broadcast, after their size is checked; with more, only rows that may be dropped are shuffled.
    """
    count, size = dropped.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    if 32 * count + (size or 0) <= SMALL_BYTES:
        return df.join(F.broadcast(dropped), key, "left_anti").select(df.columns)
    hashed = dropped.select(F.xxhash64(key).alias("__h"))
    some = bloom(hashed, "__h", count)
    flagged = df.withColumn("__maybe", some.holds(F.xxhash64(key)))
    clear = flagged.filter(~F.col("__maybe")).drop("__maybe")
    return clear.unionByName(flagged.filter("__maybe").drop("__maybe").join(dropped, key, "left_anti"))
