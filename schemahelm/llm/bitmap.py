"""A hashed bit map of bounded size: a filter that never misses a member, whatever the number of members.

It is built on the executors in blocks and only ever has ``max_bits`` bits, so its broadcast has a fixed bound. With
more members than it has room for it lets more strangers pass, and what follows it (a join) still decides exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**28 bits are 32 MB.
MAX_BITS = 28
_BLOCK_BITS = 16


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def bitmap(df: DataFrame, value: Column, max_bits: int = MAX_BITS) -> Broadcast:
    """Broadcast bit map of the 64-bit ``value`` of all rows; its size follows their number up to ``2**max_bits`` bits."""
    values = df.select(value.cast("bigint").alias("h")).distinct()
    n = values.count()
    bits = min(max_bits, max(_BLOCK_BITS, int(np.ceil(np.log2(max(1, n) * 32)))))

    def place(batches):
        for pdf in batches:
            at = _places(pdf["h"].to_numpy(), bits)
            yield pd.DataFrame({"block": (at >> np.uint64(_BLOCK_BITS)).astype(np.int64), "at": (at & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.int32)})

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(1 << _BLOCK_BITS, np.uint8)
        held[pdf["at"].to_numpy()] = 1
        return pd.DataFrame([{"block": key[0], "held": np.packbits(held, bitorder="little").tobytes()}])

    placed = values.mapInPandas(place, "block bigint, at int").distinct()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    # At most 2**max_bits / 8 bytes in blocks of 8 KB, in one job: an iterator would run one for each partition.
    for r in placed.groupBy("block").applyInPandas(fill, "block bigint, held binary").collect():
        start = r["block"] << (_BLOCK_BITS - 3)
        whole[start : start + (1 << (_BLOCK_BITS - 3))] = np.frombuffer(r["held"], np.uint8)
    return df.sparkSession.sparkContext.broadcast((bits, whole))


def has_bits(held: tuple[int, np.ndarray], values: np.ndarray) -> np.ndarray:
    """For each 64-bit value, whether its bit is set."""
    bits, whole = held
    at = _places(np.ascontiguousarray(values), bits)
    return (whole[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
