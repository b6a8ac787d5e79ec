"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact confirmation.

A window has as many words as an item; a text shorter than an item is a window too. Its fingerprint is the SimHash of its word shingles, each counted as often as it occurs.
Fingerprints are cut into blocks; of two fingerprints at most ``radius`` bits apart some block differs in at most
radius // blocks bits, so items listed under all block values that near are met by every window within the radius. Met pairs are
confirmed by the weighted Jaccard similarity of their shingles (counts as weights) on the words themselves. An item of fewer
words than a shingle is one shingle of its own.

Only windows that can reach the threshold get a fingerprint: at least t / (1 + t) of their and the item's shingles together have
to be shingles of items of that length, which a Bloom filter of the items' shingles rules out inside the task for nearly all windows.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import _MARK, Words, build_bloom, mixed, shared, shingles, slices, utf8, whole_text
from gleaner.session import written

_BLOCKS = 8  # of 8 bits
_SLICE = 1 << 18  # bytes of text handled at once: words, hashes and windows of a slice take some hundred bytes each
_BITS = 1 << 22  # bits of shingles laid out at once for fingerprints


def _sized(h: np.ndarray, n) -> np.ndarray:
    """Name of a shingle of items of n words."""
    return mixed(h ^ mixed(np.asarray(n, np.uint64)))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes; a bit is set if it is set in more than half of them."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(*h.shape, 8), axis=2)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > h.shape[1], axis=1).view(np.uint64).ravel()


def window_fingerprints(h: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the m shingle hashes from each of these places on, a bounded number of windows at a time."""
    step = max(1, _BITS // (64 * m))
    return np.concatenate([fingerprints(h[begin[i:i + step, None] + np.arange(m)[None, :]]) for i in range(0, len(begin), step)])


def needed(shingle_count: int, percent: int) -> int:
    """Least number of common shingles of two texts with that many each to reach the threshold."""
    return -(-2 * percent * shingle_count // (100 + percent))


def weighted_similarity(a: list[str], b: list[str], size: int) -> float:
    """Weighted Jaccard similarity of the shingle counts of two word lists; a list of fewer words is one shingle."""
    x, y = (Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) for w in (a, b))
    common = (x & y).total()
    return common / (x.total() + y.total() - common)


def _spelled(data: np.ndarray, w: Words, first: int, n: int) -> str:
    raw = data[w.starts[first]:w.ends[first + n - 1]].tobytes()
    begin = w.starts[first]
    return b" ".join(raw[s - begin:e - begin] for s, e in zip(
        w.starts[first:first + n].tolist(), w.ends[first:first + n].tolist())).lower().decode()


def _items(benchmark: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    id_type = benchmark.schema[item_id].dataType.simpleString()

    def go(batches):
        for part in slices(batches, "text", _SLICE):
            data, offsets = utf8(part.column("text"))
            w = Words(data, offsets, _MARK)
            count = np.bincount(w.rows, minlength=part.num_rows)
            first = np.searchsorted(w.rows, np.arange(part.num_rows))
            rows, h = shingles(w.rows, w.hashes, size)
            at, spelled, prints, lists = [], [], [], []
            for i in np.flatnonzero(count).tolist():
                own = h[np.searchsorted(rows, i):np.searchsorted(rows, i, side="right")]
                at.append(i)
                spelled.append(_spelled(data, w, int(first[i]), int(count[i])))
                prints.append(int(fingerprints(own[None, :]).view(np.int64)[0]))
                lists.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").take(pa.array(at, pa.int64())), pa.array(count[at].astype(np.int32), pa.int32()),
                 pa.array(spelled, pa.string()), pa.array(prints, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                names=["item_id", "n", "item", "print", "shingles"])

    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(go, f"item_id {id_type}, n int, item string, print long, shingles array<long>"), "items")


def _block(print_, number: int):
    return F.shiftrightunsigned(print_, 8 * number).bitwiseAND(F.lit(255)).cast("int")


def _windows(docs: DataFrame, items: DataFrame, size: int, percent: int, most_lengths: int) -> DataFrame:
    """Windows that may be similar to an item: (doc_id, row_key, n, name, print, words)."""
    spark = docs.sparkSession
    lengths = sorted(r[0] for r in items.select("n").distinct().limit(most_lengths + 1).collect())
    if len(lengths) > most_lengths:
        raise ValueError(f"items of more than {most_lengths} different lengths")

    def keys(batches):
        for b in batches:
            lists = b.column("shingles")
            if b.num_rows:
                h = lists.flatten().to_numpy().view(np.uint64)
                n = b.column("n").to_numpy()[pa.compute.list_parent_indices(lists).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[h, _sized(h, n)].view(np.int64))], names=["key"])

    known = shared(spark, build_bloom(items.select("n", "shingles").mapInArrow(keys, "key long"), "key", 18))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for part in slices(batches, "text", _SLICE):
            data, offsets = utf8(part.column("text"))
            w = Words(data, offsets, _MARK)
            rows, h = w.rows, np.zeros(len(w.rows), np.uint64)
            inside = np.zeros(len(rows), bool)
            if len(rows) >= size:
                inside[:len(rows) - size + 1] = rows[:len(rows) - size + 1] == rows[size - 1:]
                h[inside] = shingles(rows, w.hashes, size)[1][_whole_places(rows, size)]
            maybe = np.flatnonzero(inside & known.value.holds(h))
            out_rows, out_n, names, prints, words_ = [], [], [], [], []

            def add(begin, n, counts, made):
                out_rows.append(rows[begin])
                out_n.append(np.full(len(begin), n, np.int32))
                prints.append(made.view(np.int64))
                spelled = [_spelled(data, w, b, c) for b, c in zip(begin.tolist(), counts.tolist())]
                words_.extend(spelled)
                names.extend(xxhash.xxh3_128_digest(s.encode()) for s in spelled)

            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
            count = np.diff(np.r_[first, len(rows)])
            for n in lengths:
                if n < size:
                    # one shingle: the window is the item or not; once per text will do
                    begin = np.arange(max(len(rows) - n + 1, 0))
                    begin = begin[rows[begin] == rows[begin + n - 1]]
                    runs = shingles(np.repeat(np.arange(len(begin)), n), w.hashes[(begin[:, None] + np.arange(n)[None, :]).ravel()], size)[1]
                    hit = np.flatnonzero(known.value.holds(runs) & known.value.holds(_sized(runs, n)))
                    if len(hit):
                        hit = hit[np.unique(np.stack([rows[begin[hit]].astype(np.uint64), runs[hit]]), axis=1, return_index=True)[1]]
                        add(begin[hit], n, np.full(len(hit), n), fingerprints(runs[hit][:, None]))
                    continue
                m = n - size + 1
                mine = maybe[known.value.holds(_sized(h[maybe], n))]
                if not len(mine):
                    continue
                # whole texts of fewer words
                own = count - size + 1
                short = np.flatnonzero((count < n) & (own * 100 >= percent * m))
                if len(short):
                    held = np.searchsorted(mine, first[short] + own[short]) - np.searchsorted(mine, first[short])
                    short = short[held * (100 + percent) >= percent * (own[short] + m)]
                if len(short):
                    add(first[short], n, count[short], np.concatenate(
                        [fingerprints(h[None, b:b + k]) for b, k in zip(first[short].tolist(), own[short].tolist())]))
                need = needed(m, percent)
                if len(mine) < need:
                    continue
                # first word of every window with enough of these shingles
                begin = np.unique((mine[:, None] - np.arange(m)[None, :]).ravel())
                begin = begin[begin >= 0]
                begin = begin[(begin + n <= len(rows))]
                begin = begin[rows[begin] == rows[begin + n - 1]]
                held = np.searchsorted(mine, begin + m) - np.searchsorted(mine, begin)
                begin = begin[held >= need]
                if not len(begin):
                    continue
                add(begin, n, np.full(len(begin), n), window_fingerprints(h, begin, m))
            if out_rows:
                at = pa.array(np.concatenate(out_rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row_key").take(at), pa.array(np.concatenate(out_n)),
                     pa.array(names, pa.binary()), pa.array(np.concatenate(prints)), pa.array(words_, pa.string())],
                    names=["doc_id", "row_key", "n", "name", "print", "words"])

    return written(docs.mapInArrow(
        find, f"doc_id {id_type}, row_key long, n int, name binary, print long, words string"), "windows")


def _whole_places(rows: np.ndarray, size: int) -> np.ndarray:
    """Among the shingles that ``shingles`` gives, those of ``size`` words."""
    n = len(rows)
    first = np.r_[True, rows[1:] != rows[:-1]]
    whole = np.zeros(n, bool)
    whole[:n - size + 1] = rows[:n - size + 1] == rows[size - 1:]
    return whole[np.flatnonzero(whole | first)]


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", size: int = 5, percent: int = 80, radius: int = 23,
                   most_lengths: int = 10_000) -> DataFrame:
    """(doc_id, row_key, item_id, similarity): documents with a window similar to an item, its best similarity.

    Words are runs of anything but ASCII blanks and punctuation, A-Z as a-z. At 64 bits two texts of similarity 0.8 differ
    in 9.7 bits on average (deviation 2.9), so a radius of 23 loses about one such pair in a million. A document
    with fewer words than an item is compared with it as a whole. Null texts have no windows; items of fewer than ``size`` words are
    found word for word; items without words are not searched; null ids are ids; rows alike in id and
    text are one document; repeated items count once each; other columns are not looked at; empty tables give an empty one.
    """
    keyed = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(whole_text(text)).alias("row_key"), whole_text(text).alias("text"))
    items = _items(benchmark, item_id, item_text, size)
    windows = _windows(keyed, items, size, percent, most_lengths)
    near = radius // _BLOCKS
    flips = F.array(*(F.lit(sum(1 << b for b in bits)) for k in range(near + 1) for bits in combinations(range(8), k)))
    items = items.select(F.xxhash64("item_id", "item").alias("item_key"), "item_id", "n", "item", "print").dropDuplicates(["item_key"])
    listed = items.select("item_key", "n", F.col("print").alias("item_print"),
                          F.posexplode(F.array(*(_block(F.col("print"), i) for i in range(_BLOCKS)))).alias("block", "base"))
    listed = listed.select("*", F.explode(flips).alias("flip")).select(
        "item_key", "n", "item_print", "block", F.col("base").bitwiseXOR(F.col("flip")).alias("value"))
    # a window that stands in many documents is looked up once
    kinds = windows.groupBy("n", "name").agg(F.first("print").alias("print"), F.first("words").alias("words"))
    asked = kinds.select("n", "name", "print",
                         F.posexplode(F.array(*(_block(F.col("print"), i) for i in range(_BLOCKS)))).alias("block", "value"))
    # 296 rows per item: more than the size of the items shows, so this side is never broadcast
    met = (asked.join(listed.hint("merge"), ["n", "block", "value"])
           .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
           .select("n", "name", "item_key").distinct())
    met = met.join(items.select("item_key", "item_id", "item"), "item_key").join(kinds.select("n", "name", "words"), ["n", "name"]).select(
        "n", "name", "words", "item_id", "item")

    def confirm(batches):
        for b in batches:
            alike = [weighted_similarity(x.split(" "), y.split(" "), size)
                     for x, y in zip(b.column("words").to_pylist(), b.column("item").to_pylist())]
            keep = pa.array([s * 100 >= percent - 1e-9 for s in alike], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("name"), b.column("item_id"), pa.array(alike, pa.float64())],
                                             names=["n", "name", "item_id", "similarity"]).filter(keep)

    id_type = items.schema["item_id"].dataType.simpleString()
    hits = written(met.mapInArrow(confirm, f"n int, name binary, item_id {id_type}, similarity double"), "hits")
    return windows.select("doc_id", "row_key", "n", "name").join(hits, ["n", "name"]).groupBy("doc_id", "row_key", "item_id").agg(
        F.max("similarity").alias("similarity"))


def _same(docs: DataFrame, found: DataFrame, doc_id: str, text: str):
    return docs[doc_id].eqNullSafe(found["__doc"]) & (F.xxhash64(whole_text(text)) == found["__key"])


def reported(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, item_id (most similar, ties to the smaller id) and similarity, null if clean."""
    found = contaminations(docs, benchmark, doc_id, text, **settings).groupBy("doc_id", "row_key").agg(
        F.count("*").alias("n_items"), F.min(F.struct((-F.col("similarity")).alias("less"), "item_id")).alias("best"))
    found = written(found.select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), "n_items", "best"), "contaminated")
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(whole_text(text)).alias("row_key"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["__doc"]) & (rows["row_key"] == found["__key"]), "left")
    return both.select("doc_id", F.col("__key").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                       F.col("best.item_id").alias("item_id"), (-F.col("best.less")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows and columns of ``docs`` without the contaminated documents."""
    found = written(contaminations(docs, benchmark, doc_id, text, **settings).select(
        F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key")).distinct(), "contaminated")
    return docs.join(found, _same(docs, found, doc_id, text), "left_anti")
