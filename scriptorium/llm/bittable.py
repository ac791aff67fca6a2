"""A bit table of fixed size that says which 64-bit hashes may be present.

Tells the many rows that cannot find a partner before they are shuffled.  Its
size does not depend on the input; a hash that is present is always reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Place of each hash (uint64) in a table of 2^bits bits."""
    return (hashes * _MIX) >> np.uint64(64 - bits)


def present(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    s = slots(hashes, bits)
    return (table[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def build(hashes: DataFrame, bits: int, expand=None) -> np.ndarray:
    """Table of the first column (long) of ``hashes``, or of what ``expand`` makes of each array of them.

    Spark ors the bits of each 64-bit word; at most 2^(bits - 6) words reach the driver.
    """

    def run(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            s = slots(expand(x) if expand else x, bits)
            yield pa.RecordBatch.from_arrays([pa.array((s >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))], ["word", "bits"])

    words = hashes.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table
