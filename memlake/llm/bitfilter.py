"""Filters of a fixed number of bits over hashes, made on the cluster and broadcast to Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a block of the filter: what one row brings to the driver is 4 KB.
BLOCK_BITS = 1 << 15


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The place of unsigned hashes in a filter of 2^bits bits: their first bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    slot = slots(hashes, (8 * len(table)).bit_length() - 1)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _block(rows: pa.Table) -> pa.Table:
    flags = np.zeros(BLOCK_BITS, bool)
    flags[np.asarray(rows["place"])] = True
    return pa.table({"block": rows["block"].slice(0, 1), "bytes": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})


def filled(hashes: DataFrame, bits: int, table: np.ndarray | None = None) -> np.ndarray:
    """The bytes of a filter of 2^bits bits with all of ``hashes(hash)`` in it, added to ``table`` if that is given.

    Of the hashes only the filter's blocks come to the driver, 2^bits / 8 bytes at most.
    """
    table = np.zeros(1 << (bits - 3), np.uint8) if table is None else table
    slot = f"shiftrightunsigned(hash, {64 - bits})"
    places = hashes.select(F.expr(f"{slot} div {BLOCK_BITS}").alias("block"), F.expr(f"cast({slot} % {BLOCK_BITS} as int)").alias("place")).distinct()
    for row in places.groupBy("block").applyInArrow(_block, "block long, bytes binary").toLocalIterator():
        at = row["block"] * (BLOCK_BITS // 8)
        table[at : at + BLOCK_BITS // 8] |= np.frombuffer(row["bytes"], np.uint8)
    return table
