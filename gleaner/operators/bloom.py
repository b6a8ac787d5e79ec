"""Blocked Bloom filters and broadcasts that travel with their class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockedBloom:
    """Filter of fixed size: a key sets and asks four bits of one 64-bit block, so an ask is one memory access.

    Keys are well mixed 64-bit hashes. The size does not follow the data; a crowded filter passes more
    rows on to the exact join behind it and never loses one.
    """

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def bits(keys: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        out = np.zeros(len(keys), np.uint64)
        for shift in (40, 46, 52, 58):
            out |= one << ((keys >> np.uint64(shift)) & np.uint64(63))
        return out

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        bits = self.bits(keys)
        return (self.blocks[(keys & np.uint64(len(self.blocks) - 1)).astype(np.int64)] & bits) == bits


def build_bloom(keys: DataFrame, key: str, log2_blocks: int = 20) -> BlockedBloom:
    """Blocked Bloom filter of a column of 64-bit hashes, built by a grouping on the block.

    The driver gets at most ``2 ** log2_blocks`` blocks of 8 bytes, whatever the number of keys.
    """
    h = F.col(key)
    bits = F.lit(0).cast("long")
    for shift in (40, 46, 52, 58):
        place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    blocks = (keys.where(h.isNotNull())
              .select(h.bitwiseAND(F.lit((1 << log2_blocks) - 1)).alias("block"), bits.alias("bits"))
              .groupBy("block").agg(F.bit_or("bits").alias("bits")))
    table = blocks.toArrow()
    out = np.zeros(1 << log2_blocks, np.uint64)
    out[table.column("block").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return BlockedBloom(out)


def bloom_of_repeated(df: DataFrame, hashes) -> BlockedBloom:
    """Filter of the 64-bit hashes that occur more than once; ``hashes`` makes arrays of them from the batches of a task.

    The filter sees 46 bits of a hash. These leave a task sorted, as differences of four bytes, and meet in groups by their
    leading bits, of which each is a part of the filter. It has about 16 bits a hash and at most ``2 ** 22`` blocks of 8 bytes.
    """
    log2, parts = 22, 8
    low, inner = np.uint64((1 << 24) - 1), np.uint64(log2 + 24 - parts)
    bits_of = BlockedBloom.bits

    def packed(held):
        v = np.sort(np.concatenate(held))
        v = v[np.r_[np.ones(min(len(v), 2), bool), v[2:] != v[:-2]]]  # two of a kind tell as much as more
        cuts = np.searchsorted(v >> inner, np.arange((1 << parts) + 1, dtype=np.uint64))
        made = []
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            steps = np.diff(v[cuts[part]:cuts[part + 1]], prepend=np.uint64(part) << inner)
            wide = bool(steps.max() >> np.uint64(32))
            made.append((part, wide, steps.astype(np.uint64 if wide else np.uint32).tobytes()))
        columns = zip(*made)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "wide", "steps"])

    def leaving(batches):
        held, n = [], 0
        for h in hashes(batches):
            if len(h):
                held.append(((h & np.uint64((1 << log2) - 1)) << np.uint64(24)) | (h >> np.uint64(40)))
                n += len(h)
            if n >= 1 << 20:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def met(table):
        parts_, wides, steps = (table.column(c).to_pylist() for c in ("part", "wide", "steps"))
        v = np.sort(np.concatenate([np.cumsum(np.frombuffer(s, np.uint64 if w else np.uint32), dtype=np.uint64)
                                    for w, s in zip(wides, steps)])) + (np.uint64(parts_[0]) << inner)
        v = np.unique(v[1:][v[1:] == v[:-1]])
        blocks, bits = v >> np.uint64(24), bits_of((v & low) << np.uint64(40))
        heads = np.flatnonzero(np.r_[np.ones(min(len(v), 1), bool), blocks[1:] != blocks[:-1]])
        bits = np.bitwise_or.reduceat(bits, heads) if len(v) else bits
        return pa.table([pa.array(blocks[heads].astype(np.int32)), pa.array(bits.view(np.int64))], names=["block", "bits"])

    found = df.mapInArrow(leaving, "part int, wide boolean, steps binary")
    table = found.groupBy("part").applyInArrow(met, "block int, bits long").toArrow()
    out = np.zeros(1 << log2, np.uint64)
    out[table.column("block").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    full = min(table.num_rows / len(out), 1 - 1e-9)
    size = min(max((int(-np.log1p(-full) * len(out)) // 4).bit_length(), 12), log2)
    return BlockedBloom(np.bitwise_or.reduce(out.reshape(-1, 1 << size), axis=0))


class Shared:
    """A broadcast value that travels with its class, so executors need no copy of this package."""

    def __init__(self, broadcast):
        self._broadcast, self._value = broadcast, None

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._broadcast.value)
        return self._value


def shared(spark: SparkSession, value) -> Shared:
    """Broadcast of a value whose size is bounded by construction."""
    return Shared(spark.sparkContext.broadcast(cloudpickle.dumps(value)))
