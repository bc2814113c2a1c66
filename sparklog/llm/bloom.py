"""A blocked Bloom filter over a column of integers, built on the executors: its size is bounded by the number of keys asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import arrow_map, arrow_schema

#: Keys of the largest filter (32 MB).
MOST = 1 << 24
_BLOCK_BITS, _BITS_PER_KEY, _PLACES = 1 << 16, 16, 4
_KEYS = arrow_schema(block=pa.int64(), h=pa.int64())
_BLOCKS = arrow_schema(block=pa.int64(), bits=pa.binary())


def _places(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(16 * i)) & np.uint64(_BLOCK_BITS - 1)).astype(np.int64) for i in range(_PLACES)]


def _hashed(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    h = W.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return (W.mix(h) % np.uint64(blocks)).astype(np.int64), h


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[int, np.ndarray] = {}
    for batch in batches:
        block, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for b in np.unique(block).tolist():
            bits = done.setdefault(b, np.zeros(_BLOCK_BITS, bool))
            for p in _places(h[block == b]):
                bits[p] = True
    for b, bits in done.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], schema=_BLOCKS)


class Bloom:
    """Tells of keys whether they may be in the column; of those that aren't, about one in 400 passes."""

    def __init__(self, keys: DataFrame, count: int) -> None:
        """keys: one column of integers, of which there are ``count``, at most MOST."""
        if count > MOST:
            raise ValueError(f"{count} keys are too many for a filter")
        self.blocks = blocks = max(1, -(-count * _BITS_PER_KEY // _BLOCK_BITS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, h = _hashed(batch.column(0).to_numpy(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(h.view(np.int64))], schema=_KEYS)

        rows = arrow_map(arrow_map(keys, run, _KEYS).repartition("block"), _built, _BLOCKS).collect()
        self.bits = np.zeros((blocks, _BLOCK_BITS // 8), np.uint8)
        for r in rows:
            self.bits[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        block, h = _hashed(keys, self.blocks)
        out = np.ones(len(keys), bool)
        for p in _places(h):
            out &= self.bits[block, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 == 1
        return out
