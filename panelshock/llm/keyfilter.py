"""A broadcast bit filter of 64-bit keys: it lets a scan drop most rows that cannot meet
others before they are shuffled. Its size is bounded; where keys outnumber the bits it lets
more through, and only the shuffle grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BLOCK_BITS = 18, 29, 15


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of a partition's cells, a row per block."""
    width = 1 << BLOCK_BITS
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        cells = np.unique(np.asarray(batch.column(1)))
        cuts = np.flatnonzero(np.diff(cells >> BLOCK_BITS)) + 1
        for part in np.split(cells, cuts):
            if len(part):
                bits = np.zeros(width, dtype=bool)
                bits[part & (width - 1)] = True
                block, packed = int(part[0] >> BLOCK_BITS), np.packbits(bits)
                blocks[block] = blocks[block] | packed if block in blocks else packed
    yield pa.record_batch(
        [pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"]
    )


class KeyFilter:
    """Bits for keys that are hashes already, or for ids after ``cells``."""

    def __init__(self, bits: np.ndarray, width: int):
        self.bits, self.width = bits, width

    def holds(self, keys: np.ndarray) -> np.ndarray:
        cell = cells(keys, self.width)
        return ((self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cell of each key: top bits of a multiplicative hash."""
    return ((keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)


def _to_cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(cells(np.asarray(batch.column(0)), width))
            yield pa.record_batch([pa.array((found >> BLOCK_BITS).astype(np.int32)), pa.array(found)], ["block", "cell"])

    return run


def key_filter(keys: DataFrame, count: int) -> KeyFilter:
    """The filter of a table of one non-NULL long column with ``count`` rows: eight bits a key,
    between 32 KB and 64 MB."""
    width = int(np.clip(np.ceil(np.log2(max(1, count) * 8)), LEAST_BITS, MOST_BITS))
    out = np.zeros(1 << (width - 3), dtype=np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    placed = keys.mapInArrow(_to_cells(width), "block int, cell long").repartition(F.col("block"))
    for row in placed.mapInArrow(_pack, "block int, bits binary").collect():
        out[row.block * size : (row.block + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return KeyFilter(out, width)
