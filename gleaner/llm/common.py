"""Helpers of the operators: slices of Arrow batches, words and hashes of whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.bloom import BlockedBloom, Shared, bloom_of_repeated, build_bloom, shared
from gleaner.operators.bounds import small
from gleaner.session import written

__all__ = ["BlockedBloom", "Shared", "Words", "bloom_of_repeated", "build_bloom", "free_names", "hash_of", "held_out", "mixed", "numbered", "ranked", "shared", "shingles", "slices", "small_batches", "utf8", "whole_text"]

SLICE_BYTES = 1 << 20  # text handled at once inside a task; one longer text is a slice of its own


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let tasks get long texts in Arrow batches of few rows; a setting of the session, left alone if it is smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Record batches cut so that the texts of one piece take about ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0)
        group = np.cumsum(np.asarray(sizes, dtype=np.int64)) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(at, to - at)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values, so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _POWERS = 0x9FB21C651E98DF25, {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n + 1:
        size = (n // (1 << 18) + 1) << 18  # as long as the texts of this task ask for
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _POWERS[name] = np.multiply.accumulate(values)
    return _POWERS["up"], _POWERS["down"]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


_MARK = np.zeros(256, bool)  # ASCII that is neither letter nor digit
_MARK[:128] = [not chr(i).isalnum() for i in range(128)]


class Words:
    """Words of all rows of a slice: first byte, end, row and 64-bit hash.

    A word is a run of bytes outside ``apart`` (by default the ASCII blanks) within one row. Hashes see A-Z as a-z.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _BLANK):
        solid = ~apart[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        start, last = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1] | first[1:-1]
        last[:-1] &= ~solid[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        self.offsets = offsets
        up, self._down = _powers(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * up[:len(data)], out=self._sums[1:])
        self.hashes = self.of(self.starts, self.ends)

    def offset(self, row: int) -> int:
        return self.offsets[row]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any stretches of bytes; equal stretches have equal hashes."""
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def hash_of(words: list[str]) -> np.ndarray:
    """The hash that ``Words`` gives each of these words."""
    data, offsets = utf8(pa.array(words, pa.string()))
    w = Words(data, np.zeros(1, np.int64), np.zeros(256, bool))
    return w.of(offsets[:-1], offsets[1:])


_STEPS = mixed(np.arange(11, 43, dtype=np.uint64))


def shingles(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of ``size`` words; a row of fewer words has its whole sequence as one."""
    n = len(rows)
    if not n:
        return rows, hashes
    first = np.r_[True, rows[1:] != rows[:-1]]
    whole = np.zeros(n, bool)
    runs = max(n - size + 1, 0)
    whole[:runs] = rows[:runs] == rows[size - 1:]
    at = np.flatnonzero(whole | first)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        to = np.minimum(at + j, n - 1)
        inside = (at + j < n) & (rows[to] == rows[at])
        total += np.where(inside, mixed(hashes[to] + _STEPS[j]), _STEPS[-1 - j]) * _STEPS[j]
    return rows[at], mixed(total)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def whole_text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their ``rank`` (from 0) within ``tree`` by ``order`` and the number ``n`` of rows of the tree.

    The table is range partitioned over all trees at once, so a tree of any size is spread; equal rows are told
    apart by their place in the input, so a run of them is spread too. Only counts per partition and tree
    are added up in a window (one row per tree and partition it reaches).
    """
    columns = df.columns
    order_keys = ["tree", *order, "row"]
    at = written(df.withColumn("row", F.monotonically_increasing_id()).orderBy(*order_keys)
                 .select(*columns, F.monotonically_increasing_id().alias("at")), "order")
    at = at.withColumn("part", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    counts = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c")).select(
        "tree", "part", "first", F.sum("c").over(tree).alias("n"),
        F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(counts, ["tree", "part"]).select(*columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "n")


def numbered(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The rows with a number from 0 among those with equal (never null) ``keys``; which of them gets which is open.

    Rows whose keys occur once are not moved. The others are ranked over all tasks, so any number of rows may be alike.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*(F.col(k).alias(f"again_{i}") for i, k in enumerate(keys)))
    again = written(again, "repeated-keys")
    first = F.lit(0).cast("long").alias(number)
    if again.isEmpty():
        return df.select("*", first)
    packed = df.select(F.struct(*(df[c] for c in df.columns)).alias("packed"), *(df[k].alias(f"key_{i}") for i, k in enumerate(keys)))
    packed = packed.join(small(again, F.lit(8 * len(keys))), [F.col(f"key_{i}") == F.col(f"again_{i}") for i in range(len(keys))], "left")
    alike = packed.where("again_0 is not null").select(F.concat_ws(" ", *(f"key_{i}" for i in range(len(keys)))).alias("tree"), "packed")
    alike = ranked(written(alike, "repeated-rows"), []).select("packed.*", F.col("rank").alias(number))
    return packed.where("again_0 is null").select("packed.*", first).unionByName(alike)
