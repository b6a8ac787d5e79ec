"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each half is quantised by its own centroids, and a vector lies in the cell of its two
nearest. A query walks through the cells by growing sum of its distances to the two centroids, with a heap that holds the
border of the cells already taken, until enough entries are gathered, and ranks these entries by the exact inner product.

Neighbouring cells share a region of bounded size, a large cell is cut over several. A query travels once to each region
in which it has cells, with the list of them. Walks grow about tenfold, from the nearest cells to all that are wanted: each but the last
finds a score that k entries reach, and on the next only entries that reach this bound leave a task. A bound is true whichever
entries it comes from, so for it a region gives no more than its part of 2 k. What leaves per query follows from the ratio of two walks, whose
number grows with the logarithm of the table, and not from the number of regions.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import shared
from gleaner.session import written

_REGION = 2048  # entries of one region
_FIRST = 10  # times k entries looked at on the first walk
_MET = ["region", "piece", "entry", "vec_id", "v", "cells", "bound", "most"]


def _usable(vectors: DataFrame, vec_id: str, embedding: str, width: int | None = None) -> tuple[DataFrame, int]:
    """Vectors without nulls, with finite components, not all zero, of one width (by default the most frequent)."""
    v = F.col(embedding)
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & ok & F.exists(v, lambda x: x != 0)).select(
        F.col(vec_id).alias("vec_id"), v.alias("v"))
    if width is None:
        most = rows.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
        width = most["w"] if most else 0
    return rows.where(F.size("v") == width), width


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means of a bounded sample; an empty cluster keeps its place."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def visited(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (row-major number) by growing ``left[i] + right[j]`` until they hold ``wanted`` entries; empty ones are passed."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    x, y = left[a].tolist(), right[b].tolist()
    table = sizes[np.ix_(a, b)]
    heap, gathered, out = [(x[0] + y[0], 0, 0)], 0, []
    while heap and gathered < wanted:
        _, i, j = heapq.heappop(heap)
        if table[i, j]:
            gathered += int(table[i, j])
            out.append(int(a[i]) * len(y) + int(b[j]))
        # a cell enters once: along its row, and at the row's start down to the next
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def walks(first: int, wanted: int) -> list[int]:
    """Entries looked at on each walk, from ``first`` to ``wanted``, about ten times as many on each."""
    steps = max(1, round(math.log10(wanted / first)))
    return [*(round(first * (wanted / first) ** (i / steps)) for i in range(steps)), wanted]


def _best(row, ids, k: int):
    """The k largest scores, ties to smaller ids; ``ids`` are sorted, entries not looked at have -inf."""
    at = np.flatnonzero(row > -np.inf)
    if len(at) > k:
        least = np.partition(row[at], len(at) - k)[len(at) - k]
        above, equal = at[row[at] > least], at[row[at] == least]
        at = np.concatenate([above, equal[:k - len(above)]])
    return ids[at], row[at]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
            cells: int | None = None, share: float = 0.4, least: int = 200, sample: int = 20_000) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): of each query the k entries with the largest inner product found.

    ``queries`` is a table like ``vectors`` (ids are long). The index is fitted on about ``sample`` vectors chosen by a hash
    of the id, with ``cells`` centroids per half (by default three times the root of the rows, 8 to 128), and holds
    every vector. At least ``share`` of the entries and ``least`` of them are ranked per query, all if there are fewer. Other columns are
    not looked at. Unusable vectors (null, zero,
    null or non-finite components, another width than most) take no part, on either side; rows repeating a query's id are not
    its neighbours; a repeated query is asked once. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    entries, width = _usable(vectors, vec_id, embedding)
    n = entries.count()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out_schema)
    asked = _usable(queries, vec_id, embedding, width)[0].dropDuplicates(["vec_id"])
    part = min(1.0, sample / n)
    chosen = entries.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).limit(2 * sample)
    fit = _matrix(chosen.orderBy("vec_id").select("v").toArrow().column("v").combine_chunks())
    half = fit.shape[1] // 2
    count = cells or int(np.clip(round(3 * n ** 0.5), 8, 128))
    halves = (fit[:, :half], fit[:, half:]) if half else (fit, np.zeros((len(fit), 1)))
    centres = shared(spark, (half, [_centroids(x, count) for x in halves]))

    def both(v, half):
        return (v[:, :half], v[:, half:]) if half else (v, np.zeros((len(v), 1)))

    def place(batches):
        half, (first, second) = centres.value
        for b in batches:
            if b.num_rows:
                x, y = both(_matrix(b.column("v")), half)
                cell = _distances(x, first).argmin(axis=1) * len(second) + _distances(y, second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32))],
                                                 names=["vec_id", "v", "cell"])

    v_type = entries.schema["v"].dataType.simpleString()
    index = written(entries.mapInArrow(place, f"vec_id long, v {v_type}, cell int"), "multi-index")
    counts = index.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # at most cells ** 2 rows
    k_left, k_right = (len(c) for c in centres.value[1])
    sizes = np.zeros(k_left * k_right, np.int64)
    sizes[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    pieces = np.maximum(1, -(-sizes // _REGION)).astype(np.int32)
    # cells in order fill regions; a cell of several pieces has its regions to itself
    region, filled = np.zeros(len(sizes), np.int32), _REGION
    at = -1
    for c in range(len(sizes)):
        if filled + sizes[c] > _REGION or pieces[c] > 1:
            at, filled = at + 1, 0
        region[c] = at
        filled += int(sizes[c]) if pieces[c] == 1 else _REGION
    plan = shared(spark, (sizes.reshape(k_left, k_right), region, pieces))

    def walk(batches, gather, last):
        half, (first, second) = centres.value
        table, region, pieces = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            x, y = both(_matrix(b.column("v")), half)
            rows, regions, parts, lists, most = [], [], [], [], []
            for i, (p, q) in enumerate(zip(_distances(x, first), _distances(y, second))):
                own = np.sort(np.array(visited(p, q, table, gather), np.int32))
                r, held = region[own], table.ravel()[own]
                total = held.sum()
                cuts = np.r_[0, np.flatnonzero(r[1:] != r[:-1]) + 1, len(own)]
                for s, e in zip(cuts[:-1], cuts[1:]):
                    part = -(-2 * k * held[s:e].sum() // (total * pieces[own[s]]))
                    for piece in range(pieces[own[s]]):
                        rows.append(i)
                        regions.append(r[s])
                        parts.append(piece)
                        lists.append(own[s:e])
                        most.append(k if last else min(k, int(part)))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(regions, pa.int32()), pa.array(parts, pa.int32()), pa.array([False] * len(rows)),
                 b.column("vec_id").take(rows), b.column("v").take(rows), pa.array(lists, pa.list_(pa.int32())), b.column("bound").take(rows),
                 pa.array(most, pa.int32())], names=_MET)

    def spread(batches):
        _, region, pieces = plan.value
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                mixed_ids = b.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                lists = pa.ListArray.from_arrays(np.arange(len(cell) + 1, dtype=np.int32), b.column("cell"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region[cell]), pa.array((mixed_ids.astype(np.int64) % pieces[cell]).astype(np.int32)),
                     pa.array([True] * len(cell)), b.column("vec_id"), b.column("v"), lists, pa.nulls(len(cell), pa.float64()),
                     pa.nulls(len(cell), pa.int32())], names=_MET)

    schema = f"region int, piece int, entry boolean, vec_id long, v {v_type}, cells array<int>, bound double, most int"
    # a walk costs much more than its row, so it does not follow the row's size
    asked = written(asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id"), "multi-index-asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(asked, gather, last):
        met = index.mapInArrow(spread, schema).unionByName(asked.mapInArrow(lambda b: walk(b, gather, last), schema))
        found = (met.repartition("region", "piece").sortWithinPartitions("region", "piece", F.desc("entry"), "vec_id")
                 .mapInArrow(_scored, "query_id long, vec_id long, score double"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    *early, wanted = walks(_FIRST * k, max(least, int(np.ceil(share * n))))
    bounded = asked.withColumn("bound", F.lit(None).cast("double"))
    for gather in early:
        near = best(bounded, gather, False).where(F.col("rank") == k)
        bounds = written(near.select(F.col("query_id").alias("vec_id"), F.col("score").alias("found")), "multi-index-bounds")
        bounded = bounded.join(bounds, "vec_id", "left").select("vec_id", "v", F.greatest("bound", "found").alias("bound"))
    return best(bounded, wanted, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scored(batches):
    """Entries of a region come first, by id; its visitors then pass in blocks and leave with the best (``most`` of them) that reach their bound."""
    key, ids, vectors, cells = None, [], [], []

    def visit(q_ids, q, offsets, asked, bounds, most):
        nonlocal ids, vectors, cells
        ids, vectors, cells = [np.concatenate(ids)], [np.concatenate(vectors)], [np.concatenate(cells)]
        by_cell = np.argsort(cells[0], kind="stable")
        ranked = cells[0][by_cell]
        names, found, scores = [], [], []
        for s in range(0, len(q_ids), 256):
            e = min(s + 256, len(q_ids))
            score = np.full((e - s, len(ids[0])), -np.inf)
            which, own = np.repeat(np.arange(e - s), np.diff(offsets[s:e + 1])), asked[offsets[s]:offsets[e]]
            order = np.argsort(own, kind="stable")
            which, own = which[order], own[order]
            cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = by_cell[np.searchsorted(ranked, own[a]):np.searchsorted(ranked, own[a], side="right")]
                if len(at):
                    # every pair is summed alike, so equal vectors have equal scores
                    rows = which[a:b]
                    for t in range(0, len(at), 512):
                        score[np.ix_(rows, at[t:t + 512])] = (q[s + rows][:, None, :] * vectors[0][at[t:t + 512]][None, :, :]).sum(axis=2)
            score[(q_ids[s:e, None] == ids[0][None, :]) | (score < bounds[s:e, None])] = -np.inf
            for i in range(e - s):
                f, x = _best(score[i], ids[0], most[s + i])
                names.append(np.full(len(f), q_ids[s + i]))
                found.append(f)
                scores.append(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(names)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))],
            names=["query_id", "vec_id", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        code = (b.column("region").to_numpy().astype(np.int64) << 32) | b.column("piece").to_numpy()
        entry, name, v = np.asarray(b.column("entry")), b.column("vec_id").to_numpy(), _matrix(b.column("v"))
        lists, bounds = b.column("cells"), np.nan_to_num(b.column("bound").to_numpy(zero_copy_only=False), nan=-np.inf)
        most = pa.compute.fill_null(b.column("most"), 0).to_numpy()
        offsets = np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
        flat = lists.flatten().to_numpy()
        cuts = np.r_[0, np.flatnonzero((code[1:] != code[:-1]) | (entry[1:] != entry[:-1])) + 1, len(code)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if code[s] != key:
                key, ids, vectors, cells = code[s], [], [], []
            if entry[s]:
                ids.append(name[s:e])
                vectors.append(v[s:e])
                cells.append(flat[offsets[s]:offsets[e]])
            elif ids:
                yield visit(name[s:e], v[s:e], offsets[s:e + 1] - offsets[s], flat[offsets[s]:offsets[e]], bounds[s:e], most[s:e])
