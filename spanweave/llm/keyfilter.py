"""A filter of 64-bit keys with a bounded size: it may let foreign keys through, it never stops one of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 27  # 16 MB, whatever the input
SLICES = 64


class KeyFilter:
    """Two bits a key; ``bits`` has a power of two of them."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be one of the filter's."""
        mask = np.uint64(len(self.bits) * 8 - 1)
        out = np.ones(keys.shape, bool)
        for k in (keys, keys >> np.uint64(32)):
            at = k & mask
            out &= (self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return out


def key_filter(keys: DataFrame) -> KeyFilter:
    """Filter of the one long column of ``keys``, built by slices on the executors; about 16 bits a key up to ``MAX_BITS``."""
    count, size = keys.count(), 1 << 16
    while size < min(16 * count, MAX_BITS):
        size *= 2
    each = size // SLICES
    key = F.col(keys.columns[0])
    places = keys.select(F.explode(F.array(F.pmod(key, F.lit(size)), F.pmod(F.shiftrightunsigned(key, 32), F.lit(size)))).alias("place"))
    places = places.select(F.floor(F.col("place") / each).cast("int").alias("slice"), (F.col("place") % each).cast("int").alias("place")).distinct()

    def build(rows: pa.Table) -> pa.Table:
        own = np.zeros(each, np.uint8)
        own[rows["place"].to_numpy()] = 1
        return pa.table({"slice": rows["slice"].slice(0, 1), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in places.groupBy("slice").applyInArrow(build, "slice int, bits binary").toLocalIterator():
        out[r["slice"] * each // 8 : (r["slice"] + 1) * each // 8] = np.frombuffer(r["bits"], np.uint8)
    return KeyFilter(out)
