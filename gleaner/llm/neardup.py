"""Near-duplicate documents by bottom-k sketches from one hash function, confirmed on full shingle sets.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets with Jaccard similarity t or more share
a value among the first n - ceil(t n) + 1 of each, in any order common to all documents. So the retained values of
a document are that many smallest hashes, and inverted lists of them meet every linked pair, without chance. Values that very many
documents retain are put last in the order (by a Bloom filter, which every task asks alike), so that common lines don't make
long lists; groups of equal sets are one class and enter once.

Short lists give pairs. First each class meets its most promising partner of each list, then, when those links are
confirmed and folded into components, only pairs across components are left to look at; a pair whose sketches show too
little overlap is passed over. Sketches of up to 64 values then estimate the similarity from the smallest values of
the union, and what may reach the threshold is confirmed on the full sets.

Long lists never give pairs. Classes that long lists connect form a group, cut into blocks of bounded size. A few leaders meet all
blocks first; what they connect has to meet only what they left. Two blocks meet in one task, count common shingles of
their full sets and pass on only links that connect what was not connected yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Words, build_bloom, free_names, shared, shingles, slices, utf8, whole_text
from gleaner.session import written

_SKETCH = 64  # values of the union sketch
_OUTLINE = [f"o{i}" for i in range(4)]  # 256 bits set by the smallest values, used inside lists
_LONG = 64  # members from which a list is long
_BLOCK_CLASSES, _BLOCK_BYTES = 2048, 16 << 20  # of a block of a group, about
_LEADERS = 16  # classes that a whole group meets at once
_HUB = 64  # links from which a node may be a hub
_FOLDED = 1 << 16  # links folded at once inside a task, about
_KNOWN = 100_000  # nodes between others that every task may know


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words."""
    data, offsets = utf8(column)
    w = Words(data, offsets)
    rows, hashes = shingles(w.rows, w.hashes, size)
    cuts = np.searchsorted(rows, np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]


def _retained(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _outline(values: np.ndarray) -> list[int]:
    """256 bits with one set for each of the smallest values."""
    places = (values[:_SKETCH] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bits = np.zeros(4, np.uint64)
    np.bitwise_or.at(bits, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
    return bits.view(np.int64).tolist()


def _least_overlap(percent: int) -> float:
    """Share of common sketch values that a linked pair misses by five standard deviations only."""
    t = percent / 100
    return max(0.2, t - 5 * (t * (1 - t) / _SKETCH) ** 0.5)


def _popular(docs: DataFrame, size: int, percent: int, often: int) -> DataFrame:
    """Values that at least ``often`` different sets have among twice as many smallest values as they retain."""

    def values(batches):
        for part in slices(batches, "text"):
            seen, out = set(), []
            for s in shingle_sets(part.column("text"), size):
                if len(s) and (key := s.tobytes()) not in seen:
                    seen.add(key)
                    out.append(s[:2 * _retained(len(s), percent)])
            if out:
                found, n = np.unique(np.concatenate(out), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], names=["value", "n"])

    return (docs.select("text").mapInArrow(values, "value long, n int").groupBy("value").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= often).select("value"))


def _sketches(docs: DataFrame, size: int, percent: int, popular) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for part in slices(batches, "text"):
            names, counts, kept, outlines, small = [], [], [], [], []
            for s in shingle_sets(part.column("text"), size):
                counts.append(len(s))
                if not len(s):
                    for out in (names, kept, small):
                        out.append(None)
                    outlines.append([None] * 4)
                    continue
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                late = popular.value.holds(s)
                kept.append(np.concatenate([s[~late], s[late]])[:_retained(len(s), percent)].view(np.int64))
                outlines.append(_outline(s))
                small.append(s[:_SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row_key"), pa.array(names, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(kept, pa.list_(pa.int64())), 
                 *(pa.array(column, pa.int64()) for column in zip(*outlines)), pa.array(small, pa.binary())],
                names=["doc_id", "row_key", "cls", "n", "kept", *_OUTLINE, "sketch"])

    return docs.mapInArrow(sketch, f"doc_id {id_type}, row_key long, cls binary, n long, kept array<long>, o0 long, o1 long, o2 long, o3 long, "
                           "sketch binary")


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _similar(a, b, percent: int) -> np.ndarray:
    """Overlap of the outlines of two groups of members as a matrix, -1 where sizes or outlines rule a link out."""
    n_a, n_b = a["n"][:, None], b["n"][None, :]
    ok = (np.minimum(n_a, n_b) * 100 >= percent * np.maximum(n_a, n_b))
    both = sum(_pop(a[o][:, None] & b[o][None, :]).astype(np.int16) for o in _OUTLINE)
    least = np.minimum(a["bits"][:, None], b["bits"][None, :])
    return np.where(ok & (both >= least * _least_overlap(percent)), both * np.int32(128) // np.maximum(least, 1), -1)


def _list_pairs(lists: DataFrame, percent: int, across: bool) -> DataFrame:
    """Pairs of classes from short inverted lists; ``lists`` has value, cls, n, the outline, comp.

    ``across``: all similar pairs of different components, else each member with its most similar one.
    """
    ordered = lists.select("value", "cls", "n", *_OUTLINE, "comp").repartition("value").sortWithinPartitions("value")

    def pairs(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            value = held.column("value").to_numpy()
            new = np.flatnonzero(value[1:] != value[:-1]) + 1
            if len(new):
                yield from groups(held.slice(0, new[-1]), np.r_[0, new])
                held = held.slice(new[-1])
        if held is not None and held.num_rows:
            yield from groups(held, np.array([0, held.num_rows]))

    def groups(table, cuts):
        names = table.column("cls").combine_chunks()
        columns = {"n": table.column("n").to_numpy(), "comp": table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()}
        columns |= {o: table.column(o).to_numpy().view(np.uint64) for o in _OUTLINE}
        columns["bits"] = sum(_pop(columns[o]).astype(np.int32) for o in _OUTLINE)
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            own = {k: v[a:b] for k, v in columns.items()}
            score = _similar(own, own, percent)
            score[own["comp"][:, None] == own["comp"][None, :]] = -1
            if across:
                p, q = np.nonzero((score >= 0) & ~np.tri(b - a, dtype=bool))
            else:
                best = score.argmax(axis=1)
                p = np.flatnonzero(score[np.arange(b - a), best] >= 0)
                q = best[p]
            left.append(p + a)
            right.append(q + a)
        if left:
            left, right = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right))], names=["a", "b"])

    found = ordered.mapInArrow(pairs, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(members: DataFrame, texts: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (node, comp) by the ``known`` links and all links within the groups; ``members`` has cls and comp, the group's name.

    A group of several blocks meets a few leaders first, each block in a task of its own with copies of them. The component that
    then holds most of the group is its bulk. Classes of the bulk are connected, so only the rest still has to meet: with itself
    and with the bulk. Leaders are taken from what is left again as long as that halves it. Every two blocks that have to meet do
    so under a key of their own, so a large group is many tasks, each of about two blocks.
    """
    def blocks_of(which):
        n, total = F.count_if(which), F.coalesce(F.sum(F.when(which, F.col("bytes"))), F.lit(0))
        return F.greatest(F.ceil(n / _BLOCK_CLASSES), F.ceil(total / _BLOCK_BYTES)).cast("int")

    rows = written(members.join(texts.select("cls", F.octet_length("text").alias("bytes")), "cls"), "members")
    blocks = written(rows.groupBy("comp").agg(blocks_of(F.lit(True)).alias("blocks")), "blocks")
    alone = blocks.where("blocks = 1").select("comp")
    own = rows.join(alone, "comp").select("comp", "cls", F.lit(0).alias("mine"), F.lit(0).alias("other"))
    links = known.select("a", "b").union(written(_met(own.join(texts, "cls"), size, percent), "block-links"))
    several = written(rows.join(blocks.where("blocks > 1"), "comp").withColumn(
        "part", F.pmod(F.xxhash64("cls"), "blocks").cast("int")), "several-blocks")
    before, number = several.count(), 0
    if not before:
        return components(links, "comp-1")
    rest = several.select("comp", "cls")
    while True:
        order = Window.partitionBy("comp").orderBy(F.xxhash64("cls", F.lit(number)), "cls")
        leaders = rest.withColumn("place", F.row_number().over(order)).where(F.col("place") <= _LEADERS).select(
            "cls", F.lit(True).alias("leads"))
        open_ = several.join(rest.select("comp").distinct(), "comp", "left_semi").join(leaders, "cls", "left").join(texts, "cls")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        sides = [open_.where("leads").withColumn("part", every).withColumn("mine", F.lit(0)), open_.withColumn("mine", F.lit(1))]
        meeting = sides[0].unionByName(sides[1]).select(
            F.struct("comp", "part").alias("comp"), "cls", "text", "mine", (1 - F.col("mine")).alias("other"))
        comp = components(links.union(_met(meeting, size, percent)), f"bulk-{number}")
        links, joined = (comp.select(F.col("node").alias(x), F.col("comp").alias(y)) for x, y in (("a", "b"), ("cls", "now")))
        now = written(several.select("comp", "cls").join(joined, "cls", "left").withColumn("now", F.coalesce("now", "cls")), f"now-{number}")
        most = now.groupBy("comp", "now").agg(F.count("*").alias("n")).groupBy("comp").agg(F.max(F.struct("n", "now")).alias("most"))
        bulk = most.select("comp", "most.now")
        rest = written(now.join(bulk, ["comp", "now"], "left_anti").select("comp", "cls"), f"rest-{number}")
        left, number = rest.count(), number + 1
        if not left or 2 * left > before:
            break
        before = left
    if left:  # if not, nothing is added to what the leaders connected
        # blocks 0 .. open - 1 hold the rest, the next ones the bulk; a group without a rest is connected
        parted = several.select("comp", "cls", "bytes").join(rest.select("cls", F.lit(True).alias("in_rest")), "cls", "left").withColumn(
            "in_rest", F.coalesce("in_rest", F.lit(False)))
        sums = parted.groupBy("comp").agg(blocks_of(F.col("in_rest")).alias("open"), blocks_of(~F.col("in_rest")).alias("closed"))
        parted, h = parted.join(sums.where("open > 0"), "comp"), F.xxhash64("cls", F.lit("block"))
        mine = F.when(F.col("in_rest"), F.pmod(h, "open")).otherwise(F.col("open") + F.pmod(h, "closed")).cast("int")
        last = F.col("open") - 1 + F.when(F.col("in_rest"), F.col("closed")).otherwise(0)
        parted = parted.join(texts, "cls").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        comp = components(links.union(_met(parted.select("comp", "cls", "text", "mine", "other"), size, percent)), "comp-1")
    return comp


def _met(meeting: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between blocks ``mine`` and ``other`` of each ``comp`` for rows (comp, cls, text, mine, other); a block may meet itself."""
    keyed = meeting.select(F.xxhash64("comp").alias("key"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "text")
    keyed = keyed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(batches):
        key, held = None, []
        for batch in batches:
            for part in slices([batch], "text"):
                at = np.stack([part.column("key").to_numpy(), part.column("i").to_numpy().astype(np.int64), part.column("j").to_numpy()], axis=1)
                cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)]
                sets = shingle_sets(part.column("text"), size)
                names, mine = part.column("cls").to_pylist(), part.column("mine").to_pylist()
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if tuple(at[a]) != key:
                        if held:
                            yield met(key, held)
                        key, held = tuple(at[a]), []
                    held += zip(names[a:b], mine[a:b], sets[a:b])
        if held:
            yield met(key, held)

    def met(key, held):
        x = [k for k, h in enumerate(held) if h[1] == key[1]]
        y = x if key[1] == key[2] else [k for k, h in enumerate(held) if h[1] == key[2]]
        parent = list(range(len(held)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        left, right = [], []
        if x and y:
            # postings of the second block: where each shingle's owners stand
            n = np.array([len(held[k][2]) for k in y])
            values, owner = np.concatenate([held[k][2] for k in y]), np.repeat(np.arange(len(y)), n)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            kinds, ends = values[heads], np.r_[heads[1:], len(values)]
            for k in x:
                own = held[k][2]
                at = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
                at = at[kinds[at] == own]
                m = ends[at] - heads[at]
                place = np.arange(m.sum()) + np.repeat(heads[at] - (np.cumsum(m) - m), m)
                common = np.bincount(owner[place], minlength=len(y))
                for t in np.flatnonzero(100 * common >= percent * (len(own) + n - common)).tolist():
                    a, b = root(k), root(y[t])
                    if a != b:
                        parent[a] = b
                        left.append(held[k][0])
                        right.append(held[y[t]][0])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return keyed.mapInArrow(link, "a binary, b binary")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule the threshold out (by five standard deviations)."""
    sides = [classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")

    def estimate(batches):
        t = percent / 100
        for batch in batches:
            keep = []
            for n_a, x, n_b, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # both sketches are complete below the smaller of their last values
                top = min(x[-1] if n_a > len(x) else np.uint64(2**64 - 1), y[-1] if n_b > len(y) else np.uint64(2**64 - 1))
                x, y = x[x <= top], y[y <= top]
                shared_values = len(np.intersect1d(x, y, assume_unique=True))
                k = len(x) + len(y) - shared_values
                keep.append(shared_values / k >= t - 5 * (t * (1 - t) / k) ** 0.5)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(estimate, "a binary, b binary")


def _texts(asked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(cls, text) of the classes asked for and a few more; any text of a class serves, its set is the class."""
    ids = shared(docs.sparkSession, build_bloom(asked.select(F.xxhash64("cls").alias("h")), "h", 17))

    def texts(batches):
        for part in slices(batches, "text"):
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in shingle_sets(part.column("text"), size)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), part.column("text")], names=["cls", "text"])

    named = docs.select("text").mapInArrow(texts, "cls binary, text string").where("cls is not null")
    named = named.select("cls", "text", F.xxhash64("cls").alias("h"))

    def sieve(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(ids.value.holds(b.column("h").to_numpy().view(np.uint64)))).select(["cls", "text"])

    return written(named.mapInArrow(sieve, "cls binary, text string").groupBy("cls").agg(F.first("text").alias("text")), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full sets."""
    both = (pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))

    def confirm(batches):
        for part in slices(batches, "x"):
            keep = []
            for x, y in zip(shingle_sets(part.column("x"), size), shingle_sets(part.column("y"), size)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a binary, b binary")


def _folded(links: DataFrame) -> DataFrame:
    """Links (u, v) with v < u that connect the same nodes: each node of a stretch of links under the smallest it reaches there."""
    most = _FOLDED

    def fold(batches):
        names, parent, known, seen = [], [], {}, 0

        def number(name):
            if name not in known:
                known[name] = len(names)
                names.append(name)
                parent.append(known[name])
            return known[name]

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        def stars():
            tops = [root(k) for k in range(len(names))]
            under = [k for k, t in enumerate(tops) if k != t]
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in under], type_), pa.array([names[tops[k]] for k in under], type_)],
                                              names=["u", "v"])

        for batch in batches:
            type_ = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(number(a)), root(number(b))
                if a != b:
                    low, high = (a, b) if names[a] < names[b] else (b, a)
                    parent[high] = low
            seen += batch.num_rows
            if seen >= most:
                yield stars()
                names, parent, known, seen = [], [], {}, 0
        if names:
            yield stars()

    kind = links.schema["a"].dataType.simpleString()
    return links.select("a", "b").mapInArrow(fold, f"u {kind}, v {kind}")


def _raised(edges: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """(a, b): each edge (u, v) with the smallest node above v in the place of v, by a shuffle join. A v that more than a ten-thousandth
    of ``total`` entries count for meets its edges in place: fewer than 10,000 such are known to every task, so no hub fills one."""
    hub, top = F.col("c") > max(_HUB, total // 10_000), F.coalesce("m", "node")
    hubs = state.where(hub).select(F.col("node").alias("hub"), top.alias("hub_top"))
    rows = edges.join(F.broadcast(hubs), edges["v"] == hubs["hub"], "left").drop("hub")
    near = rows.where("hub_top is not null").select(F.col("u").alias("a"), F.col("hub_top").alias("b"))
    rest = rows.where("hub_top is null").join(state.where(~hub).select("node", top.alias("top")), F.col("v") == F.col("node"))
    return near.unionByName(rest.select(F.col("u").alias("a"), F.col("top").alias("b")))


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(node, comp): the smallest node reachable over links (a, b), one row for each node that has links.

    Edges lead from a node up to a smaller one. Each round puts them under the smallest node above their upper end (known to every
    task, if these are few), folds them in place and hangs all that is above one node under the smallest of it. Folded
    edges name a node once per stretch, so what is gathered for one is bounded by the stretches; edges of a hub stay spread. When
    nothing lies both above and below others, or below two, all stand under the smallest.
    """
    edges, number = written(_folded(links), f"{label}-links"), 0
    while True:
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("below")).union(
            edges.select("v", F.lit(None), F.lit(1)))
        state = written(ends.groupBy("node").agg(F.min("up").alias("m"), F.max("up").alias("other"), F.sum("below").alias("below"),
                                                 F.count("*").alias("c")), f"{label}-state-{number}")
        between = F.col("m").isNotNull() & (F.col("below") > 0)
        n_between, n_forked, total = state.agg(F.count_if(between), F.count_if(F.col("m") != F.col("other")), F.sum("c")).first()
        if not n_between and not n_forked:
            return state.select("node", F.coalesce("m", "node").alias("comp"))
        if n_between <= _KNOWN:
            above = state.where(between).select("node", F.col("m").alias("top"))
            raised = edges.join(F.broadcast(above), edges["v"] == above["node"], "left").select(
                F.col("u").alias("a"), F.coalesce("top", "v").alias("b"))
        else:
            raised = _raised(edges, state, total)
        over = _folded(raised).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("over"))
        below = F.explode(F.concat(F.array("u"), F.filter("over", lambda x: x != F.col("m"))))
        edges, number = written(over.select(below.alias("u"), F.col("m").alias("v")), f"{label}-{number}"), number + 1


def _grown(comp: DataFrame, links: DataFrame, label: str) -> DataFrame:
    """Components (node, comp) by further ``links``: only what the links connect is looked at, by the names of its components."""
    for end in "ab":
        named = comp.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
        links = links.join(named, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    lifted = links.where("comp_a != comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    tops = components(lifted, label)
    old = comp.join(tops.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    new = tops.join(comp.select("node"), "node", "left_anti")
    return written(old.select("node", F.coalesce("top", "comp").alias("comp")).union(new.select("node", "comp")), f"{label}-grown")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 85,
                    often: int = 48) -> DataFrame:
    """Per row: doc_id, row_key (hash of the text), n_shingles, cls (name of its set), comp (name of its component),
    component_id (smallest doc_id linked to it over any steps).

    Null and texts without words have no set and are linked with nothing: component_id is their own id. Rows of one set are
    one class, so repeated rows and ids are fine; null ids count as larger than any other, and a group of
    null ids only has a null component_id. Other columns are not looked at; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(whole_text(text)).alias("row_key"), docs[text].alias("text"))
    popular = shared(spark, build_bloom(_popular(plain, size, percent, often), "value", 18))
    rows = written(_sketches(plain, size, percent, popular), "sketches")
    classes = written(rows.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("kept").alias("kept"),
        *(F.first(o).alias(o) for o in _OUTLINE), F.first("sketch").alias("sketch")), "classes")
    sizes = written(classes.select(F.explode("kept").alias("value")).groupBy("value").agg(F.count("*").alias("size"))
                    .where("size > 1"), "list-sizes")
    met = shared(spark, build_bloom(sizes, "value"))

    def shared_values(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kept = b.column("kept")
            values, parents = kept.flatten(), pa.compute.list_parent_indices(kept)
            hit = pa.array(met.value.holds(values.to_numpy().view(np.uint64)))
            rows_of = parents.filter(hit)
            yield pa.RecordBatch.from_arrays(
                [values.filter(hit), *(b.column(c).take(rows_of) for c in ("cls", "n", *_OUTLINE))],
                names=["value", "cls", "n", *_OUTLINE])

    lists = written(classes.select("cls", "n", *_OUTLINE, "kept").mapInArrow(
        shared_values, "value long, cls binary, n long, o0 long, o1 long, o2 long, o3 long").join(sizes, "value"), "lists")
    # classes that long lists connect form groups
    long = lists.where(F.col("size") > _LONG)
    stars = long.select("value", F.col("cls").alias("a")).join(long.groupBy("value").agg(F.min("cls").alias("b")), "value")
    group = components(stars.select("a", "b"), "groups").select(F.col("node").alias("cls"), "comp")
    short = written(lists.where(F.col("size") <= _LONG).drop("size"), "short-lists")
    # whoever has a similar partner in a list has a most similar one, so these are all classes that short lists can link
    first = written(_list_pairs(short.withColumn("comp", F.col("cls")), percent, across=False), "pairs-1")
    texts = _texts(first.select(F.col("a").alias("cls")).union(first.select("b")).union(group.select("cls")).distinct(), plain, size)
    links = written(_confirmed(_estimated(first, classes, percent), texts, size, percent), "links-0")
    comp = _grouped(group, texts, links, size, percent)
    named = short.join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    second = _list_pairs(named, percent, across=True).join(first, ["a", "b"], "left_anti")
    more = written(_confirmed(_estimated(second, classes, percent), texts, size, percent), "links-2")
    comp = _grown(comp, more, "comp-2")
    of_class = classes.select("cls", "least").join(comp.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn(
        "comp", F.coalesce("comp", "cls"))
    lowest = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(lowest, "comp").select("cls", "comp", "component_id")
    return rows.join(of_class, "cls", "left").select(
        "doc_id", "row_key", F.col("n").alias("n_shingles"), "cls", "comp",
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows and columns of ``docs`` with one row of each group of near-duplicates: that of the smallest id.

    Texts without words are duplicates of nothing and all stay. Of rows alike in id one stays, too.
    """
    found = near_duplicates(docs, doc_id, text, **settings).where("cls is not null")
    doc, key, comp, stays, h = free_names(docs, "__doc", "__key", "__comp", "__stays", "__h")
    found = written(found.select(F.col("doc_id").alias(doc), F.col("row_key").alias(key), F.col("comp").alias(comp),
                                 F.col("doc_id").eqNullSafe(F.col("component_id")).alias(stays)), "groups")

    def at(table):
        return docs[doc_id].eqNullSafe(table[doc]) & (F.xxhash64(whole_text(text)) == table[key])

    gone = found.where(~F.col(stays)).select(doc, key).distinct()
    # only rows that repeat an id can leave two rows of one group
    repeats = found.where(stays).groupBy(comp).agg(F.count("*").alias("n")).where("n > 1").select(comp)
    twice = written(found.where(stays).join(repeats, comp).select(doc, key, comp).distinct(), "repeats")
    if twice.isEmpty():
        # only rows that may be gone travel to the join; the filter has a fixed size and passes a few more
        bloom = shared(docs.sparkSession, build_bloom(gone, key, 18))
        rows = docs.select("*", F.xxhash64(whole_text(text)).alias(h))
        names = docs.columns

        def side(may_be_gone: bool):
            def go(batches):
                for b in batches:
                    if b.num_rows:
                        hit = bloom.value.holds(b.column(h).to_numpy().view(np.uint64))
                        yield b.filter(pa.array(hit == may_be_gone)).select(names)

            return rows.mapInArrow(go, docs.schema)

        maybe = side(True)
        same = maybe[doc_id].eqNullSafe(gone[doc]) & (F.xxhash64(whole_text(text)) == gone[key])
        return side(False).unionByName(maybe.join(gone, same, "left_anti"))
    once = docs.join(twice, at(twice)).dropDuplicates([comp]).select(*docs.columns)
    rest = gone.unionByName(twice.select(doc, key))
    return docs.join(rest, at(rest), "left_anti").unionByName(once)
