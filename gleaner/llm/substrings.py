"""Repeated passages: suffixes ordered by their first ``depth`` bytes only, by most-significant-digit passes.

A suffix matters only through its first ``depth`` bytes (its window); groups of equal windows are the repeated passages.
The windows are ordered by passes over digits, and a group that is down to one member falls out after each pass:

1. The first digit is the ``k`` bytes with the smallest hash inside the window (the earliest on a tie). Equal windows
   have the same digit at the same place, and a run of neighbouring windows shares one, so the pass sorts about
   2 / (depth - k + 2) rows per byte instead of one per byte.
2. The second digit is everything the run's windows cover. In a group of equal runs all but the first run have an
   earlier copy of each of their windows, and are decided at once.
3. First runs that still share their first digit with others are taken apart. Neighbouring windows at like places go
   together under the bytes they have in common; where those repeat, the last digit is the rest of each window. Equal groups
   are exactly the repeated windows.

Whatever is not first inside a task is not first at all, so a task settles its own repeats and passes on one row per digit;
a passage in a third of all texts costs a row per task, not per text. Passes 1 and 3 read the texts again behind
a Bloom filter of fixed size instead of keeping a row for every suffix; its false hits fall out in the grouping.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import _BASE, _BYTE, bloom_of_repeated, build_bloom, mixed, shared, slices, utf8, whole_text
from gleaner.session import written

_SLICE = 1 << 20
_SEGMENT = 1 << 24  # a longer text is looked at in stretches that overlap by depth - 1 bytes


def _stretches(batches, depth: int):
    """(rows of the batch part, bytes, offsets, position of the first byte in its text)."""
    for part in slices(batches, "text", _SLICE):
        data, offsets = utf8(part.column("text"))
        if part.num_rows == 1 and len(data) > _SEGMENT:
            for at in range(0, len(data) - depth + 1, _SEGMENT):
                piece = data[at:at + _SEGMENT + depth - 1]
                yield part, piece, np.array([0, len(piece)]), at
        else:
            yield part, data, offsets, 0


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:len(keys) - (width - size)], keys[width - size:]) if size < width else keys


def digit_runs(data: np.ndarray, offsets: np.ndarray, depth: int, k: int):
    """Runs of windows that share their first digit: (row, first window, last window, place and hash of the digit)."""
    none = np.empty(0, np.int64)
    if len(data) < depth:
        return none, none, none, none, np.empty(0, np.uint64)
    h, size, power = _BYTE[data], 1, _BASE
    while size * 2 <= k:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = size * 2, power * power % (1 << 64)
    bits = np.uint64(max(int(len(data)).bit_length(), 1))
    order = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    at = (_smallest(order, depth - k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(len(at), bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - depth + 1):end] = False
    new = np.r_[True, at[1:] != at[:-1]]
    new[1:] |= ~inside[:-1]
    last = np.r_[new[1:], True]
    last[:-1] |= ~inside[1:]
    first, final = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    digit = at[first]
    return np.searchsorted(offsets, first, side="right") - 1, first, final, digit, mixed(h[digit])


def _digits(batches, depth: int, k: int):
    for _, data, offsets, _ in _stretches(batches, depth):
        yield digit_runs(data, offsets, depth, k)[-1]


def _whole(data, first, final, digit, depth: int) -> np.ndarray:
    """Hash of all bytes that the windows of each run cover, and of the digit's place among them."""
    view, ask = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    return np.fromiter((ask(view[a:b], d) for a, b, d in zip(
        first.tolist(), (final + depth).tolist(), (digit - first).tolist())), np.uint64, len(first))


def _run_name(digit: np.ndarray, whole: np.ndarray, keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed(digit ^ whole * np.uint64(3)) ^ keys) ^ start)


class _Gathered:
    """Rows of a task until they are many; places are comparable numbers that order texts by id (null first) and key."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.rows, self.texts, self.columns = most, 0, [], []

    def add(self, part, rows: np.ndarray, *columns: np.ndarray) -> bool:
        self.texts.append((part.column("doc_id"), part.column("row_key")))
        first = sum(len(t[0]) for t in self.texts[:-1])
        self.columns.append((rows + first, *columns))
        self.rows += len(rows)
        return self.rows >= self.most

    def take(self):
        """(ids, keys, text of each row, rank of its text, further columns), and start anew."""
        ids, keys = pa.concat_arrays([t[0] for t in self.texts]), pa.concat_arrays([t[1] for t in self.texts])
        table = pa.table([ids, keys], names=["doc_id", "row_key"])
        order = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row_key", "ascending")],
                                        null_placement="at_start").to_numpy()
        sorted_ids, sorted_keys = ids.take(pa.array(order)).to_pylist(), keys.to_numpy()[order]
        new = [False, *(a != b for a, b in zip(sorted_ids[1:], sorted_ids))] if len(order) else []
        new = np.array(new, bool)
        new[1:] |= sorted_keys[1:] != sorted_keys[:-1]
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(new)
        rows, *columns = (np.concatenate(c) for c in zip(*self.columns))
        self.__init__(self.most)
        return ids, keys, rows, rank[rows], columns


def _later(names: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows whose name also stands at a smaller place."""
    order = np.lexsort((place, names))
    names, place = names[order], place[order]
    head = np.maximum.accumulate(np.where(np.r_[True, names[1:] != names[:-1]], np.arange(len(names)), 0))
    out = np.empty(len(names), bool)
    out[order] = place != place[head]
    return out


def _place(rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (rank << np.uint64(36)) | start.astype(np.uint64)


def repeated_spans(docs: DataFrame, depth: int = 100, k: int = 32, width: int = 8) -> DataFrame:
    """Stretches (doc_id, row_key, start, end) that repeat an earlier window, overlapping ones among them.

    ``docs`` has doc_id, row_key and text; earlier is by id (null first), then row_key, then position. ``width`` is the
    number of neighbouring windows that go together in the third pass.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    asked = shared(spark, bloom_of_repeated(docs.select("text"), lambda b: _digits(b, depth, k)))

    def possible(batches):
        for part, data, offsets, shift in _stretches(batches, depth):
            rows, first, final, digit, names = digit_runs(data, offsets, depth, k)
            hit = asked.value.holds(names)
            rows, first, final, digit, names = rows[hit], first[hit], final[hit], digit[hit], names[hit]
            yield part, data, rows, first, final, digit, names, _whole(data, first, final, digit, depth), shift - offsets[rows]

    def runs(batches):
        held = _Gathered()

        def settled():
            ids, keys, rows, rank, (names, whole, start, more) = held.take()
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(at), keys.take(at), pa.array(names.view(np.int64)), pa.array(whole.view(np.int64)),
                 pa.array(start), pa.array(more.astype(np.int16)),
                 pa.array(_later(mixed(names ^ mixed(whole)), _place(rank, start)))],
                names=["doc_id", "row_key", "digit", "whole", "start", "more", "later"])

        for part, _, rows, first, final, _, names, whole, shift in possible(batches):
            if held.add(part, rows, names, whole, first + shift, final - first):
                yield settled()
        if held.texts:
            yield settled()

    found = written(docs.mapInArrow(
        runs, f"doc_id {id_type}, row_key long, digit long, whole long, start long, more short, later boolean"), "runs")
    place = ["doc_id", "row_key", "start"]
    ranked = written(found.where("not later").drop("later").withColumn(
        "rank", F.rank().over(Window.partitionBy("digit", "whole").orderBy(*place))), "ranked-runs")
    end = (F.col("start") + F.col("more") + depth).alias("end")
    copies = found.where("later").select(*place, end).unionByName(ranked.where("rank > 1").select(*place, end))
    # only first runs whose first digit is shared with a different run can hold further repeats
    firsts = ranked.where("rank = 1").select("digit", "whole", "row_key", "start")
    open_digits = (firsts.groupBy("digit").agg(F.min("whole").alias("a"), F.max("whole").alias("b"))
                   .where("a != b").select("digit"))
    to_split = firsts.join(open_digits, "digit", "left_semi")

    def name_runs(batches):
        for b in batches:
            columns = [b.column(i).to_numpy().view(np.uint64) for i in range(4)]
            names = _run_name(*columns[:3], columns[3])
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64))], names=["name"])

    wanted = shared(spark, build_bloom(to_split.mapInArrow(name_runs, "name long"), "name", 22))

    def split_runs(batches):
        """Runs that are taken apart and the bytes common to all windows of a group of neighbours, hashed once per group."""
        ask = xxhash.xxh3_64_intdigest
        for part, data, rows, first, final, digit, names, whole, shift in possible(batches):
            hit = wanted.value.holds(_run_name(names, whole, part.column("row_key").to_numpy()[rows].view(np.uint64),
                                               (first + shift).astype(np.uint64)))
            rows, first, final, digit, shift = rows[hit], first[hit], final[hit], digit[hit], shift[hit]
            # windows first..final start final - first places apart from the digit, fewest last: a group is a range of these places
            most, least = digit - first, digit - final
            n = most // width - least // width + 1
            owner = np.repeat(np.arange(len(first)), n)
            low = (most[owner] // width - (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))) * width
            begin, view = digit[owner] - low, memoryview(np.ascontiguousarray(data))
            core = np.fromiter((ask(view[a:b], x) for a, b, x in zip(begin.tolist(), (begin - width + 1 + depth).tolist(), low.tolist())),
                               np.uint64, len(owner))
            yield part, view, rows, first, final, digit, shift, owner, low, core

    # a window that repeats lies in a group whose common bytes repeat; few groups do
    common = shared(spark, bloom_of_repeated(docs, lambda b: (x[-1] for x in split_runs(b))))

    def windows(batches):
        held = _Gathered()

        def settled():
            ids, keys, rows, rank, (run, left, at, core, rest) = held.take()
            later = _later(mixed(core ^ mixed(rest + left.astype(np.uint64))), _place(rank, at))
            # settled windows: neighbours in one text fold into stretches
            r, s = rows[later], at[later]
            order = np.lexsort((s, r))
            r, s = r[order], s[order]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)]) if len(r) else np.empty(0, np.int64)
            last = np.r_[new[1:], len(r)] - 1 if len(r) else new
            owner = pa.array(r[new], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(owner), keys.take(owner), pa.array(mixed(s[new].astype(np.uint64) + mixed(rank[later][order][new])).view(np.int64)),
                 pa.array(s[new]), pa.array(s[last] + depth), pa.nulls(len(new), pa.list_(pa.int64()))], names=names_out)
            # the others: one row for each group of neighbours
            keep = ~later
            rows, run, left, at, core, rest = rows[keep], run[keep], left[keep], at[keep], core[keep], rest[keep]
            group = np.r_[True, (run[1:] != run[:-1]) | (core[1:] != core[:-1])] if len(run) else np.empty(0, bool)
            number = np.cumsum(group) - 1
            n = int(number[-1]) + 1 if len(number) else 0
            table, empty = np.zeros((n, width), np.int64), np.ones((n, width), bool)
            table[number, left % width] = rest.view(np.int64)
            empty[number, left % width] = False
            heads = np.flatnonzero(group)
            owner = pa.array(rows[heads], pa.int64())
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width,
                                             pa.array(table.ravel(), mask=empty.ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.take(owner), keys.take(owner), pa.array(core[heads].view(np.int64)), pa.array(at[heads] + left[heads] % width),
                 pa.nulls(n, pa.int64()), lists], names=names_out)

        count, ask = 0, xxhash.xxh3_64_intdigest
        for part, view, rows, first, final, digit, shift, owner, low, core in split_runs(batches):
            hit = common.value.holds(core)
            owner, low, core = owner[hit], low[hit], core[hit]
            # windows of a group: those of its run that start low to low + width - 1 places before the digit
            begin = np.maximum(digit[owner] - low - width + 1, first[owner])
            n = np.minimum(digit[owner] - low, final[owner]) - begin + 1
            group = np.repeat(np.arange(len(owner)), n)
            at = begin[group] + np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            owner, core = owner[group], core[group]
            left = digit[owner] - at
            rest = np.fromiter((ask(view[p:p + depth]) for p in at.tolist()), np.uint64, len(at))
            if held.add(part, rows[owner], owner + count, left, at + shift[owner], core, rest):
                yield from settled()
            count += len(first)
        if held.texts:
            yield from settled()

    names_out = ["doc_id", "row_key", "core", "start", "end", "rest"]
    split = docs.mapInArrow(windows, f"doc_id {id_type}, row_key long, core long, start long, end long, rest array<long>")
    # the exchange on the common bytes serves both windows; groups that nothing else shares end here
    split = split.withColumn("n", F.count("*").over(Window.partitionBy("core"))).where("n > 1 or end is not null")
    single = split.select("doc_id", "row_key", "core", "end", "start", F.posexplode_outer("rest").alias("left", "rest"))
    single = single.withColumn("start", F.col("start") - F.coalesce("left", F.lit(0)))
    rank = F.rank().over(Window.partitionBy("core", "left", "rest").orderBy(*place))
    later = single.where("rest is not null or end is not null").withColumn("rank", rank).where("rank > 1 or end is not null")
    return copies.unionByName(later.select(*place, F.coalesce("end", F.col("start") + depth).alias("end")))


def _bounds(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = stretches >> 31
    return start, start + (stretches & (1 << 31) - 1)


def _folded(batches):
    """Stretches of each row in order, those that touch or overlap as one."""
    for batch in batches:
        lists = batch.column("spans").cast(pa.large_list(pa.int64()))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        stretches = lists.flatten().to_numpy()
        order = np.lexsort((stretches, row))
        row, (start, end) = row[order], _bounds(stretches[order])
        reach = np.maximum.accumulate(end + (row << 32))  # a row begins beyond all that the one before reaches
        new = np.flatnonzero(np.r_[np.ones(min(len(row), 1), bool), start[1:] + (row[1:] << 32) > reach[:-1]])
        last = np.r_[new[1:], len(row)] - 1 if len(row) else new
        whole = (start[new] << 31) + (reach[last] - (row[last] << 32)) - start[new]
        offsets = np.searchsorted(row[new], np.arange(len(lists) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))],
            names=["doc_id", "row_key", "spans"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 100, k: int = 32,
                    kept: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left).

    A byte goes if a ``depth``-byte string over it also starts earlier: in a row with a smaller id, or earlier in the
    same text. Null ids come first; different texts of one id are ordered by a hash; rows alike in id and text are one
    document and get the same result each. Null and empty texts have nothing to remove; texts shorter than ``depth`` stay
    whole; other columns are not looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(whole_text(text)).alias("row_key"), whole_text(text).alias("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    # a stretch is one number, its start and below that its length
    stretch = F.shiftleft("start", 31) + F.col("end") - F.col("start")
    found = repeated_spans(keyed, depth, k).select("doc_id", "row_key", stretch.alias("stretch"))
    spans = written(found.groupBy("doc_id", "row_key").agg(F.collect_set("stretch").alias("spans"))
                    .mapInArrow(_folded, f"doc_id {id_type}, row_key long, spans array<long>"), "spans")
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("row_key").alias("span_key"), "spans")
    touched = shared(spark, build_bloom(spans, "span_key", 18))
    result = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept

    def rows_of(part, data, offsets, spans):
        raw = data.tobytes()
        sizes, gone, runs, left = np.diff(offsets), [], [], []
        for a, b, own in zip(offsets.tolist(), offsets[1:].tolist(), spans):
            if not own:
                left.append(raw[a:b])
                gone.append(0)
                runs.append(0)
                continue
            s, e = _bounds(np.array(own, np.int64))
            left.append(b"".join(raw[a + x:a + y] for x, y in zip([0, *e.tolist()], [*s.tolist(), b - a])))
            gone.append(int((e - s).sum()))
            runs.append(len(s))
        columns = [pa.array(sizes), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                   pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
        return [part.column("doc_id"), *columns] + ([pa.array(left, pa.binary())] if kept else [])

    out_names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * kept

    def untouched(batches):
        """Texts without spans are done here; only the others travel to their spans."""
        for part in slices(batches, "text"):
            open_ = touched.value.holds(part.column("row_key").to_numpy().view(np.uint64))
            done, rest = part.filter(pa.array(~open_)), part.filter(pa.array(open_))
            if done.num_rows:
                data, offsets = utf8(done.column("text"))
                made = rows_of(done, data, offsets, [None] * done.num_rows)
                yield pa.RecordBatch.from_arrays([*made, done.column("row_key"), pa.nulls(done.num_rows, pa.string())],
                                                 names=[*out_names, "row_key", "text"])
            if rest.num_rows:
                none = [pa.nulls(rest.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
                none += [pa.nulls(rest.num_rows, pa.binary())] * kept
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), *none, rest.column("row_key"), rest.column("text")],
                                                 names=[*out_names, "row_key", "text"])

    first = keyed.mapInArrow(untouched, f"{result}, row_key long, text string")
    both = first.join(spans, first["doc_id"].eqNullSafe(spans["span_id"]) & (first["row_key"] == spans["span_key"]), "left")

    def cut(batches):
        for part in slices(batches, "text"):
            is_open = part.column("text").is_valid()
            done, rest = part.filter(pa.compute.invert(is_open)), part.filter(is_open)
            if done.num_rows:
                yield done.select(out_names)
            if rest.num_rows:
                data, offsets = utf8(rest.column("text"))
                yield pa.RecordBatch.from_arrays(rows_of(rest, data, offsets, rest.column("spans").to_pylist()), names=out_names)

    return both.select(*out_names, "text", "spans").mapInArrow(cut, result)
