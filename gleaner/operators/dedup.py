"""Five deduplication rules, each with an explicit order column.

``order`` is real data and unique per row; no rule depends on how Spark happens to lay rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.bloom import build_bloom, shared
from gleaner.session import written


def keep_first(df: DataFrame, keys: list[str], order: str, wide: bool = False) -> DataFrame:
    """First row per key.

    Aggregates before the shuffle, so a hot key costs one row per task. ``wide`` rows (texts) stay out
    of the aggregation: only the winning order values travel, and the rows follow by a semi join on
    the unique order column.
    """
    if wide:
        winners = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
        return df.join(winners, order, "left_semi")
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_last_value(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row's values per key at the first row's place (map semantics)."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"), F.min(order).alias(order)) \
        if rest else df.groupBy(*keys).agg(F.min(order).alias(order))
    columns = [*keys, "_row.*", order] if rest else [*keys, order]
    return best.select(*columns).select(*df.columns)


def keep_longest(df: DataFrame, keys: list[str], length: Column, order: str) -> DataFrame:
    """Row with the greatest length per key (earliest on ties) at the first row's place."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = df.withColumn("_len", length).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct((-F.col("_len")).alias("_len"), order)).alias("_row"),
        F.min(order).alias(order),
    )
    return best.select(*keys, "_row.*", order).select(*df.columns)


def drop_exact(df: DataFrame, text: Column, order: str) -> DataFrame:
    """Keep the first of all rows whose texts are equal apart from white space."""
    # 128-bit digest plus length stands for the text, so texts are not shuffled twice
    key = T.squeeze(text)
    keyed = df.withColumn("_digest", F.md5(key.cast("binary"))).withColumn("_size", F.length(key))
    return keep_first(keyed, ["_digest", "_size"], order, wide=True).drop("_digest", "_size")


def greedy_unique(files: Column) -> Column:
    """Keep a file (``file_name``, ``file_url``) if neither its url nor its name was kept before."""

    def step(kept, f):
        seen = F.exists(kept, lambda k: (k["file_url"] == T.strip(f["file_url"]))
                        | (k["file_name"] == T.strip(f["file_name"])))
        clean = F.struct(T.strip(f["file_name"]).alias("file_name"), T.strip(f["file_url"]).alias("file_url"))
        return F.when(seen, kept).otherwise(F.concat(kept, F.array(clean)))

    empty = F.array().cast("array<struct<file_name:string,file_url:string>>")
    return F.aggregate(files, empty, step)


# -- containment ------------------------------------------------------------------------------
#
# A text is dropped if an earlier text contains it. Containment is transitive, so "contained in an
# earlier kept text" and "contained in any earlier text" select the same rows and no iteration is needed.
#
# Finding containers without comparing all pairs: winnowing (Schleimer, Wilkerson, Aiken, SIGMOD 2003)
# in a few classes c. Class c hashes all c-grams and selects, in each run of c
# consecutive grams, the leftmost smallest one. Every run inside a text also occurs in whatever
# contains it, so all selected grams of the contained text are selected there too, at the same
# distance from each other. A text of length n belongs to the largest class with 2c-1 <= n and needs only
# ONE of its grams (its rarest) to meet all its containers. Counts in a fixed number of places tell which one that is
# while still inside the task, so a text leaves it with one gram; a place shared by many grams only makes a worse choice.
#
# Pairs (text, container) are never formed. Texts that look for the same gram at the same offset with
# the same length share one probe; a probe cuts that stretch out of the container, and the digest of
# the stretch is joined with the digests of the texts. A gram held by a third of all texts therefore costs
# its occurrences times the few distinct (offset, length) shapes, however many texts look for it.


_CLASSES = [1, 2, 4, 8, 16, 64, 256, 1024, 4096, 16384, 65536]  # dense where texts are short
_COUNTERS = 1 << 20  # places that count grams; a text looks for the gram whose place has the smallest count
_PIECE = 1 << 20  # characters handled at once; longer texts are read in overlapping pieces


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _run_minima(values, c):
    """Smallest of every c consecutive values (block prefix and suffix minima)."""
    padded = np.full(-(-len(values) // c) * c, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, c)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - c + 1], ahead[c - 1 : len(values)])


def _selected_grams(h, sizes, runs, c):
    """(gram key, text number, offset) of the grams class c selects; ``runs`` caps each text's run starts."""
    starts = np.cumsum(sizes) - sizes
    n_runs = np.minimum(runs, np.maximum(sizes - (2 * c - 1) + 1, 0))
    if not n_runs.any():
        return None
    # hash in the high bits, place in the low ones: ties go to the left
    packed = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    minima = _run_minima(packed, c)
    owner = np.repeat(np.arange(len(sizes)), n_runs)
    run = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs - starts, n_runs)
    at = (minima[run] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    at, owner = at[new], owner[new]
    return _mix(h[at] ^ np.uint64(c * 2654435761)).view(np.int64), owner, at - starts[owner]


def _own_class(sizes):
    """Largest class whose 2c-1 characters fit (0 for the empty text)."""
    own = np.zeros(len(sizes), np.int64)
    for c in _CLASSES:
        own[sizes >= 2 * c - 1] = c
    return own


def _pieces(texts):
    """(row, characters, offset, whole length, run starts) of each text or piece of a long text."""
    overlap = 2 * _CLASSES[-1]
    for row, text in enumerate(texts):
        for begin in range(0, max(len(text) - overlap, 1), _PIECE):
            last = begin + _PIECE >= len(text) - overlap
            part = text[begin:] if last else text[begin : begin + _PIECE + overlap]
            yield row, part, begin, len(text), len(part) if last else _PIECE


def _chunks(pieces):
    chunk, total = [], 0
    for piece in pieces:
        if chunk and total + len(piece[1]) > _PIECE:
            yield chunk
            chunk, total = [], 0
        chunk.append(piece)
        total += len(piece[1])
    if chunk:
        yield chunk


def _grams_of(chunk, ords, classes, own_only, wanted, counts=None):
    rows, parts, begins, lengths, runs = (list(x) for x in zip(*chunk, strict=True))
    rows, begins, lengths, runs = (np.array(x, np.int64) for x in (rows, begins, lengths, runs))
    sizes = np.array([len(p) for p in parts], np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _own_class(lengths)
    h, width = _mix(codes.astype(np.uint64) + np.uint64(1)), 1
    for c in classes:
        while width < c and len(h) > width:
            h = _mix(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
            width *= 2
        if width < c or len(h) < c:
            return
        found = _selected_grams(h, sizes, np.where(own == c, runs, 0) if own_only else runs, c)
        if found is None:
            continue
        keys, owner, pos = found
        if wanted is not None:
            hit = wanted.holds(keys.view(np.uint64))
            keys, owner, pos = keys[hit], owner[hit], pos[hit]
        if counts is None:
            more, names = [], ["key", "ord", "pos", "n"]
        else:
            seen = counts[keys & (_COUNTERS - 1)]
            by = np.lexsort((pos, keys, seen, owner))
            best = by[np.flatnonzero(np.r_[True, np.diff(owner[by]) != 0])]
            keys, owner, pos = keys[best], owner[best], pos[best]
            more, names = [pa.array(seen[best])], ["key", "ord", "pos", "n", "seen"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), ords.take(pa.array(rows[owner])), pa.array(pos + begins[owner]), pa.array(lengths[owner]), *more],
            names=names)


def _texts(batches, only):
    """(orders, texts) of batches (ord, text, key); ``only`` (a Bloom filter of keys) drops most texts with other keys."""
    for batch in batches:
        if only is not None:
            batch = batch.filter(pa.array(only.value.holds(batch.column(2).to_numpy().view(np.uint64))))
        yield batch.column(0), batch.column(1).to_pylist()


def _keyed(texts: DataFrame) -> DataFrame:
    return texts.select("ord", "text", F.xxhash64("ord").alias("key"))


def containment_grams(texts: DataFrame, classes: list[int], own_only: bool = False, wanted=None, only=None) -> DataFrame:
    """Selected grams of (ord, text) rows for the given classes.

    ``own_only`` restricts each text to its own class; ``wanted`` (a Bloom filter of keys) drops grams nobody looks
    for while still inside the task; its false hits fall out when grams meet their keys.
    """

    def grams(batches):
        for ords, found in _texts(batches, only):
            for chunk in _chunks(_pieces(found)):
                yield from _grams_of(chunk, ords, classes, own_only, wanted.value if wanted else None)

    kind = texts.schema["ord"].dataType.simpleString()
    return _keyed(texts).mapInArrow(grams, f"key bigint, ord {kind}, pos bigint, n bigint")


def gram_counts(texts: DataFrame, classes: list[int], only=None) -> np.ndarray:
    """How many selected grams of all (ord, text) rows fall on each place.

    Counts leave a task and reach the driver in runs of places, each number as narrow as its run allows.
    """
    size = _COUNTERS // 64

    def count(batches):
        held = np.zeros(_COUNTERS, np.int64)
        for ords, found in _texts(batches, only):
            for chunk in _chunks(_pieces(found)):
                for made in _grams_of(chunk, ords, classes, False, None):
                    held += np.bincount(made.column(0).to_numpy() & (_COUNTERS - 1), minlength=_COUNTERS)
        kinds = [np.min_scalar_type(int(run.max())).str for run in held.reshape(-1, size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(64), pa.int32()), pa.array(kinds), pa.array([run.astype(k).tobytes() for run, k in zip(held.reshape(-1, size), kinds)])],
            names=["run", "kind", "counts"])

    def added(table):
        total = np.zeros(size, np.int64)
        for kind, counts in zip(table.column("kind").to_pylist(), table.column("counts").to_pylist()):
            total += np.frombuffer(counts, kind).astype(np.int64)
        return pa.table({"run": table.column("run")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    found = _keyed(texts).mapInArrow(count, "run int, kind string, counts binary").groupBy("run").applyInArrow(added, "run int, counts binary")
    counts = np.zeros(_COUNTERS, np.int64)
    for row in found.toArrow().to_pylist():
        counts[row["run"] * size:(row["run"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return counts


def rarest_grams(texts: DataFrame, classes: list[int], counts, only=None) -> DataFrame:
    """The gram (key, ord, pos, n, seen) of its own class that each text looks for; a very long text has one per piece."""

    def grams(batches):
        for ords, found in _texts(batches, only):
            for chunk in _chunks(_pieces(found)):
                yield from _grams_of(chunk, ords, classes, True, None, counts.value)

    kind = texts.schema["ord"].dataType.simpleString()
    return _keyed(texts).mapInArrow(grams, f"key bigint, ord {kind}, pos bigint, n bigint, seen bigint")


def _filter_of(keys: DataFrame, key: str, rows: int):
    """Bloom filter of a column of keys: 16 bits a row and up to 32 MB, as a crowded one would let all texts through."""
    return shared(keys.sparkSession, build_bloom(keys, key, min(max((rows // 4).bit_length(), 12), 22)))


def _stretches(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, n, ord) of the stretches (ord, start from 0, size) of texts; all of one text are cut in one pass over it.

    Very long texts are asked in groups by where the stretches start, so no row holds more than a piece's.
    """
    asked = written(probes.groupBy("ord", F.floor(F.col("start") / _PIECE).alias("piece"))
                    .agg(F.collect_set(F.struct("start", "size")).alias("asked")), "asked-stretches")
    only = _filter_of(asked.select(F.xxhash64("ord").alias("key")), "key", asked.count())
    kind = texts.schema["ord"].dataType.simpleString()

    def held(batches):
        """Texts that nobody asks stay where they are."""
        for batch in batches:
            batch = batch.filter(pa.array(only.value.holds(batch.column(2).to_numpy().view(np.uint64))))
            yield batch.select(["ord", "text"])

    def cut(batches):
        for batch in batches:
            texts_, ords = batch.column(0), batch.column(1)
            for row in range(batch.num_rows):
                text = texts_[row].as_py()
                asked = batch.column(2)[row].values
                starts, sizes = asked.field("start").to_pylist(), asked.field("size").to_pylist()
                for at in range(0, len(starts), 10_000):
                    made = [hashlib.md5(text[s:s + n].encode("utf-8", "surrogatepass")).digest() for s, n in zip(starts[at:at + 10_000], sizes[at:at + 10_000])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made, pa.binary()), pa.array(sizes[at:at + 10_000], pa.int64()), ords.take(pa.array([row] * len(made), pa.int64()))],
                        names=["digest", "n", "ord"])

    found = _keyed(texts).mapInArrow(held, f"ord {kind}, text string")
    return asked.join(found, "ord").select("text", "ord", "asked").mapInArrow(cut, f"digest binary, n bigint, ord {kind}")


def _digest(text: str) -> Column:
    # 128-bit digest plus length stands for a text
    return F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest")


def uncontained_orders(texts: DataFrame) -> DataFrame:
    """``ord`` of every text (ord, text) that no earlier text contains or equals.

    Texts don't meet to find equal ones, their digests do; a Bloom filter of the first orders then keeps most of the others
    out of each task. What it lets through can only be one more container, later than its equal.
    """
    texts = written(texts.select("ord", "text"), "texts", "zstd")
    digests = texts.select("ord", F.length("text").cast("bigint").alias("n"), _digest("text"))
    firsts = written(digests.groupBy("digest", "n").agg(F.min("ord").alias("ord")).where("ord is not null").select("ord", "n"), "first-texts")
    number = firsts.count()
    only = None if number == texts.count() else _filter_of(firsts.select(F.xxhash64("ord").alias("key")), "key", number)
    own_class = F.lit(0)
    for c in _CLASSES:
        own_class = F.when(F.col("n") >= 2 * c - 1, c).otherwise(own_class)
    # one row per class, twelve at most
    classes = sorted(r["class"] for r in firsts.select(own_class.alias("class")).distinct().collect() if r["class"])
    counts = shared(texts.sparkSession, gram_counts(texts, classes, only))
    own = written(rarest_grams(texts, classes, counts, only), "own-grams")
    wanted = _filter_of(own, "key", own.count())
    grams = containment_grams(texts, classes, wanted=wanted, only=only)
    chosen = own.groupBy("ord", "n").agg(F.min(F.struct("seen", "key", "pos")).alias("best"))
    shapes = chosen.groupBy(F.col("best.key").alias("key"), F.col("best.pos").alias("offset"),
                            F.col("n").alias("size")).agg(F.max("ord").alias("latest"))
    probes = grams.join(shapes, "key").where(
        (F.col("n") > F.col("size")) & (F.col("ord") < F.col("latest")) & (F.col("pos") >= F.col("offset"))
        & (F.col("pos") - F.col("offset") + F.col("size") <= F.col("n"))
    ).select("ord", (F.col("pos") - F.col("offset")).alias("start"), "size")
    stretches = _stretches(probes, texts)
    # the empty text is part of every text
    anywhere = firsts.agg(F.min("ord").alias("ord")).select(F.unhex(F.md5(F.lit("").cast("binary"))).alias("digest"),
                                                           F.lit(0).cast("bigint").alias("n"), "ord")
    earliest = stretches.unionByName(anywhere).groupBy("digest", "n").agg(F.min("ord").alias("holder"))
    contained = digests.join(earliest, ["digest", "n"]).where("holder < ord").select("ord")
    return firsts.select("ord").join(contained, "ord", "left_anti")


def uncontained(df: DataFrame, text: Column, order: str) -> DataFrame:
    """``order`` of the rows whose white-space-free text no earlier row's equals or contains."""
    return uncontained_orders(df.select(F.col(order).alias("ord"), T.squeeze(text).alias("text"))).withColumnRenamed("ord", order)


def drop_contained(df: DataFrame, text: Column, order: str) -> DataFrame:
    """Drop every row whose white-space-free text equals or is part of an earlier row's."""
    return df.join(uncontained(df, text, order), order, "left_semi")
