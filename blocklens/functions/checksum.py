"""CRC32 of a whole from the CRC32s of its blocks.

The checksum is linear: each block's value, moved over the bytes that follow
the block, adds by exclusive or.  Moving over ``n`` bytes is a product with
``x^(8n)`` in the checksum's ring.  So the ordered fold becomes a plain,
partially aggregated ``bit_xor`` over blocks, in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_POLYNOMIAL = np.uint32(0xEDB88320)  # reflected; bit 31 is x^0


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of two arrays of ring elements."""
    a, out = a.astype(np.uint32), np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).astype(np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


def _squares(count: int) -> list[np.ndarray]:
    """``x^8, x^16, x^32, ...``"""
    x = np.array([1 << 30], np.uint32)
    for _ in range(3):
        x = _times(x, x)
    out = [x]
    while len(out) < count:
        out.append(_times(out[-1], out[-1]))
    return out


_BYTES = _squares(63)


def moved(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Checksums moved over ``count`` following bytes each."""
    out, count = np.asarray(crc, np.uint64).astype(np.uint32), np.asarray(count, np.int64)
    for k in range(int(count.max(initial=0)).bit_length()):
        out = np.where((count >> k) & 1, _times(_BYTES[k], out), out)
    return out


def combine(first: int, second: int, second_length: int) -> int:
    """Checksum of two runs of bytes put together."""
    return int(moved(np.array([first]), np.array([second_length]))[0]) ^ second


@F.pandas_udf(LongType())
def crc32_moved(crc: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series(moved(crc.to_numpy(np.int64), count.to_numpy(np.int64)).astype(np.int64))


def crc32_of_blocks(crc: Column, following: Column) -> Column:
    """Aggregate: checksum of the whole, from each block's checksum and the bytes after it."""
    return F.coalesce(F.bit_xor(crc32_moved(crc, following)), F.lit(0)).cast("long")


def fold_crc32(blocks: DataFrame, keys: list[str], offset: str = "raw_off", length: str = "raw_len", crc: str = "crc32", total: str | None = None) -> DataFrame:
    """``keys, crc32, size`` of each whole.

    ``offset`` is the block's place in the whole.  The whole's size is the
    column ``total`` where the blocks carry it, else it is summed first.
    """
    if total is None:
        sums = blocks.groupBy(*keys).agg(F.sum(length).alias("_total"))
        blocks, total = blocks.join(sums, keys), "_total"
    following = F.col(total) - F.col(offset) - F.col(length)
    return blocks.groupBy(*keys).agg(crc32_of_blocks(F.col(crc), following).alias("crc32"), F.coalesce(F.sum(length), F.lit(0)).alias("size"))
