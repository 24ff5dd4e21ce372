"""Tables of counts by hash slot, of a stated size, and filters of keys made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settings
from .words import _GOLD, mix

#: Slots of a block, and slots that a task gathers before it sorts and sends them.
BLOCK, GATHER = 1 << 16, 1 << 22
#: The range of the binary logarithm of the number of slots: a table of levels has 64 MB at most.
LEAST_BITS, MOST_BITS = 16, 26
_SENT = pa.schema([("block", pa.int32()), ("packed", pa.binary())])


def bits_for(n: float) -> int:
    """The binary logarithm of the number of slots for n things, within the stated range."""
    return int(np.clip(np.ceil(np.log2(max(n, 1))), LEAST_BITS, MOST_BITS))


def level_of(count: np.ndarray) -> np.ndarray:
    """A count as a byte: 0 and 1 for themselves, then eight steps for each doubling."""
    return np.minimum(np.where(count < 2, count, 1 + 8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def slot_levels(rows: DataFrame, slots: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How often each of 2 ** bits slots occurs in what `slots` gives for all batches, as
    level_of. Tasks sort what they gather and send counted blocks; blocks are summed in
    tasks, and the driver gets 2 ** bits bytes whatever the corpus is."""
    import zstandard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        waiting, size = [], 0

        def send() -> pa.RecordBatch:
            own = np.sort(np.concatenate(waiting).astype(np.uint32))
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            own, times = own[new], np.diff(np.append(new, len(own))).astype(np.uint32)
            block = own >> np.uint32(16)
            edge = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(own))
            packed = [pack((own[a:z] & np.uint32(0xFFFF)).astype(np.uint16).tobytes() + times[a:z].tobytes()) for a, z in zip(edge[:-1], edge[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], schema=_SENT)

        for b in batches:
            for some in slots(b):
                if len(some):
                    waiting.append(some.astype(np.uint32))
                    size += len(some)
                if size >= GATHER:
                    yield send()
                    waiting, size = [], 0
        if size:
            yield send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        now, total = None, np.zeros(BLOCK, np.float64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack(level_of(total).tobytes())], pa.binary())], schema=_SENT)

        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield done()
                    now, total = k, np.zeros(BLOCK, np.float64)
                raw = unpack(packed)
                n = len(raw) // 6
                total[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw[2 * n :], np.uint32)
        if now is not None:
            yield done()

    spark, schema = rows.sparkSession, "block int, packed binary"
    n = min(max(1 << bits, BLOCK) // BLOCK, partitions(spark))
    sums = rows.mapInArrow(count, schema).repartition(n, "block").sortWithinPartitions("block").mapInArrow(add, schema)
    out = np.zeros(max(1 << bits, BLOCK), np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    with settings(spark):
        for k, packed in sums.collect():  # a row for each block
            out[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(unpack(bytes(packed)), np.uint8)
    return out[: 1 << bits]


def slot_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


class KeyFilter:
    """Says of 64-bit keys whether they may be among given ones: never no for one that
    is. Two bits for a key in a map of 16 bits a key, 8 MB at most; a fuller map only lets more pass."""

    def __init__(self, keys: DataFrame, n: int):
        """keys: one column of longs; n: about how many."""
        self.bits = bits_for(16 * n)
        places = self.places
        levels = slot_levels(keys, lambda b: iter((places(b.column(0).to_numpy()).ravel(),)), self.bits)
        self.map = np.packbits(levels > 0)

    def places(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.view(np.uint64) + _GOLD)
        return np.stack([slot_of(h, self.bits), slot_of(h >> np.uint64(32), self.bits)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        on = [self.map[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 for p in self.places(keys)]
        return (on[0] & on[1]).astype(bool)
