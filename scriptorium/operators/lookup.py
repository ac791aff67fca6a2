"""Lookups inside a row: array elements found among the row's own (key, value) entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import bound_batches


def row_lookup(keys: Column, entries: Column, value_type: str, missing=None) -> Column:
    """Array of the value of the *last* entry whose key equals each element of ``keys``.

    ``entries`` is an array of structs (key, value) of the same row; elements
    without an entry, null ones included, give ``missing``.  All rows of an Arrow
    batch are looked up at once by composite keys (row, key), so the work grows with the
    elements plus the entries, not with their product.  Null arrays of keys give NULL.
    """
    bound_batches()

    @F.arrow_udf(f"array<{value_type}>")
    def look(ks: pa.Array, es: pa.Array) -> pa.Array:
        key, (entry_key, value) = ks.flatten(), es.flatten().flatten()
        n_keys, n_entries = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (ks, es))
        codes = pa.chunked_array([key, entry_key]).combine_chunks().dictionary_encode().indices
        codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        width = int(codes.max(initial=-1)) + 2  # null keys have a code of their own
        rows = np.arange(len(ks))
        wanted = np.repeat(rows, n_keys) * width + codes[: len(key)]
        there = np.repeat(rows, n_entries) * width + codes[len(key) :]
        order = np.argsort(there, kind="stable")
        there = there[order]
        at = np.searchsorted(there, wanted, "right") - 1
        hit = (at >= 0) & (codes[: len(key)] >= 0)
        hit[hit] = there[at[hit]] == wanted[hit]
        found = value.take(pa.array(order[at] if len(order) else at, mask=~hit))
        if missing is not None:
            found = pc.if_else(pa.array(hit), found, pa.scalar(missing, found.type))
        ends = pa.array(np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, found, mask=ks.is_null()) if ks.null_count else pa.ListArray.from_arrays(ends, found)

    return look(keys, entries)
