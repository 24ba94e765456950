"""Bitmaps of bounded size over hashes: a broadcast filter with no false negatives, whatever the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most bits of a bitmap: 2**30 are 128 MB. Beyond it filters let more pass; results stay.
SHARE, MOST = 64, 30


def collect_bitmap(keys: DataFrame, column: str | Column, share: int = SHARE) -> np.ndarray:
    """A bit for the low bits of each key of a (written) table; parts of 4 KB are built in the cluster.

    There are `share` to 2 * `share` bits for each key, of which one in as many is hit by other keys; at most 2**MOST / 8 bytes come here.
    """
    bits = min(MOST, max(16, (share * keys.count()).bit_length()))
    key = F.col(column) if isinstance(column, str) else column
    slot = key.bitwiseAND(F.lit((1 << bits) - 1)).cast("long") + 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = (row["part"] - 1) * 4096
        found[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return found


def hits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the bitmap."""
    slot = keys.view(np.uint64) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
