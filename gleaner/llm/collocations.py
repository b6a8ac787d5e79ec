"""Phrases whose words keep company more than their counts suggest, mined with burstable tries.

Each task counts phrases in a HAT-trie: a shallow trie over word ids whose leaves are hash containers, keyed by the rest
of the phrase. A container that grows too large bursts into a node with a container per next word. When the trie holds
too many entries, whole subtrees (all phrases with one first word) leave it as sorted runs, the largest first. Spark
shuffles the runs by phrase prefix and merges them per prefix partition.

Most phrases are rare. So a first pass adds up hashes of words and pairs of neighbours, a few bytes each, and a second one those of
longer phrases made of frequent pairs; what reaches the least count under its hash goes into a Bloom filter of
fixed size, and only phrases that pass get into the tries. Shared hashes and false hits cost a row and are removed by the
exact count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import BlockedBloom, Words, build_bloom, hash_of, mixed, shared, slices, utf8
from gleaner.operators.bounds import small
from gleaner.session import written

_BURST = 4096  # entries of a container before it bursts
_MOST = 1 << 20  # entries of a task's trie before subtrees are spilled

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)  # ends a piece
_CUT[[*b".,;:!?", *range(10, 14)]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
_PREFIX = 3  # words of a phrase that say where its runs are merged
_RUN = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("f", pa.list_(pa.int64()))])
_PAIR = np.uint64(0x9FB21C651E98DF25)


class Node:
    """A burst container: what lies below each next word, and the count of the phrase that ends here."""

    __slots__ = ("below", "own")

    def __init__(self):
        self.below: dict[bytes, dict | Node] = {}
        self.own = 0


class HatTrie:
    """Counts of phrases given as packed ids of four bytes (big-endian, so byte order is id order)."""

    def __init__(self, burst: int = _BURST):
        self.root, self.burst, self.size = Node(), burst, 0

    def add(self, phrases: list[bytes], counts: list[int]) -> None:
        top, burst = self.root.below, self.burst
        for phrase, count in zip(phrases, counts):
            at, above, home = 4, top, top.get(phrase[:4])
            while type(home) is Node:
                step = phrase[at:at + 4]
                if not step:
                    self.size += home.own == 0
                    home.own += count
                    break
                at, above, home = at + 4, home.below, home.below.get(step)
            else:
                if home is None:
                    home = above[phrase[at - 4:at]] = {}
                rest = phrase[at:]
                if rest in home:
                    home[rest] += count
                else:
                    home[rest] = count
                    self.size += 1
                    if len(home) > burst and at < len(phrase):
                        above[phrase[at - 4:at]] = self._burst(home)

    @staticmethod
    def _burst(container: dict) -> Node:
        node = Node()
        for rest, count in container.items():
            if rest:
                node.below.setdefault(rest[:4], {})[rest[4:]] = count
            else:
                node.own = count
        return node

    def _entries(self, home) -> int:
        if type(home) is dict:
            return len(home)
        return (home.own > 0) + sum(map(self._entries, home.below.values()))

    def _walk(self, before: bytes, home) -> Iterator[tuple[bytes, int]]:
        if type(home) is dict:
            for rest in sorted(home):
                yield before + rest, home[rest]
        else:
            if home.own:
                yield before, home.own
            for step in sorted(home.below):
                yield from self._walk(before + step, home.below[step])

    def spill(self, leave: int) -> Iterator[tuple[bytes, int]]:
        """Takes out whole subtrees, the largest first, until at most ``leave`` entries are left; each is a sorted run."""
        sizes = {first: self._entries(home) for first, home in self.root.below.items()}
        for first in sorted(sizes, key=lambda k: (-sizes[k], k)):
            if self.size <= leave:
                break
            self.size -= sizes[first]
            yield from self._walk(first, self.root.below.pop(first))


class Vocabulary:
    """Ids of (language, word) within a task."""

    def __init__(self):
        self.ids: dict[tuple[str, bytes], int] = {}
        self.names: list[tuple[str, bytes]] = []

    def of(self, lang: str, word: bytes) -> int:
        got = self.ids.get((lang, word))
        if got is None:
            got = self.ids[lang, word] = len(self.names)
            self.names.append((lang, word))
        return got


def _packed(columns: list[np.ndarray]) -> list[bytes]:
    table = np.stack(columns, axis=1).astype(">u4")
    data, width = table.tobytes(), 4 * len(columns)
    return [data[i:i + width] for i in range(0, len(data), width)]


class _Slice:
    """Words of a slice with their keys: mixed hashes of (language, word), and of each word and the next one."""

    def __init__(self, part):
        data, offsets = utf8(part.column("text"))
        self.data = _LOWER[data]
        self.words = words = Words(self.data, offsets, _APART)
        self.n = len(words.starts)
        coded = part.column("lang").dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy(zero_copy_only=False)[words.rows].astype(np.int64)
        if self.n:
            cuts = np.cumsum(_CUT[self.data])
            self.keys = mixed(words.hashes + hash_of(self.langs)[self.lang])
            # the next word stands in the same piece
            self.linked = (words.rows[1:] == words.rows[:-1]) & (cuts[words.starts[1:]] == cuts[words.ends[:-1] - 1])
            self.pairs = mixed(self.keys[:-1] * _PAIR + self.keys[1:])

    def frequent_links(self, hits) -> np.ndarray:
        """Whether a word and the next one are a pair that ``hits`` lets pass."""
        linked = np.zeros(self.n, bool)
        linked[:-1] = self.linked
        linked[:-1][self.linked] = hits(self.pairs[self.linked])
        return linked

    def longer(self, at: np.ndarray, keys: np.ndarray, length: int, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of phrases of ``length`` - 1 words at ``at`` those that go on, where they are among the former, and their longer keys."""
        which = np.flatnonzero(at + length - 1 < self.n)
        which = which[linked[at[which] + length - 2]]
        at = at[which]
        return at, mixed(keys[which] * _PAIR + self.keys[at + length - 1]), which

    def phrases(self, longest: int, hits, long_hits, names: Vocabulary) -> list[tuple[list[bytes], list[int]]]:
        """(phrases, counts) for each length, packed ids, of what ``hits`` (words, pairs) and ``long_hits`` let pass."""
        words, n = self.words, self.n
        linked = self.frequent_links(hits)
        used = hits(self.keys)
        single = used.copy()
        used |= linked
        used[1:] |= linked[:-1]
        at = np.flatnonzero(used)
        if not len(at):
            return []
        # the words' bytes lie end to end for the dictionary
        sizes = words.ends[at] - words.starts[at]
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) + np.repeat(words.starts[at] - (ends - sizes), sizes)
        column = pa.Array.from_buffers(pa.large_binary(), len(at), [
            None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(self.data[inside])]).dictionary_encode()
        langs, spelled = self.langs, column.dictionary.to_pylist()
        both = column.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(langs) + self.lang[at]
        distinct, which = np.unique(both, return_inverse=True)
        own = [names.of(langs[k % len(langs)], spelled[k // len(langs)]) for k in distinct.tolist()]
        ids = np.zeros(n, np.int64)
        ids[at] = np.array(own, np.int64)[which]
        out, at, node = [], np.flatnonzero(single), ids[single]
        for length in range(1, longest + 1):
            if length == 2:
                at = np.flatnonzero(linked)
                keys, node = self.pairs[at], ids[at] << 32 | ids[at + 1]
            elif length > 2:
                at, keys, which = self.longer(at, keys, length, linked)
                passed = long_hits(keys)
                at, keys, which = at[passed], keys[passed], which[passed]
                node = node[which] << 32 | ids[at + length - 1]
            distinct, first, node, counts = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
            if len(distinct):
                out.append((_packed([ids[at[first] + j] for j in range(length)]), counts.tolist()))
        return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _drop(spark) -> int:
    """Low bits of keys that are not looked at: the top bits are the part that adds a key up, the next 32 are sent."""
    # four parts to a shuffle partition, so what a part holds follows the session's sizing
    return 32 - (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()


def _frequent(docs: DataFrame, least: int, keys_of) -> BlockedBloom:
    """Filter of the keys that are found at least ``least`` times; ``keys_of`` gives the keys of a slice."""
    drop = _drop(docs.sparkSession)
    small_count = np.uint8 if least < 256 else np.int64

    def sent(keys, counts):
        part = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
        low, few = keys.astype(np.uint32), np.minimum(counts, least).astype(small_count)
        yield pa.RecordBatch.from_arrays([
            pa.array(part[starts].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([few[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["part", "keys", "counts"])

    def count(batches):
        held, new = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
        for batch in slices(batches, "text"):
            part = _Slice(batch)
            if part.n:
                new.append(keys_of(part) >> np.uint64(drop))
            if sum(map(len, new)) > _MOST:
                fresh = np.concatenate(new)
                held, new = _summed(np.r_[held[0], fresh], np.r_[held[1], np.ones(len(fresh), np.int64)]), []
                if len(held[0]) > 4 * _MOST:
                    yield from sent(*held)
                    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        fresh = np.concatenate([held[0], *new])
        held = _summed(fresh, np.r_[held[1], np.ones(len(fresh) - len(held[0]), np.int64)])
        if len(held[0]):
            yield from sent(*held)

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("keys").to_pylist()]).astype(np.uint64)
        counts = np.concatenate([np.frombuffer(b, small_count) for b in table.column("counts").to_pylist()]).astype(np.int64)
        keys, counts = _summed(keys, counts)
        whole = keys[counts >= least] | np.uint64(table.column("part")[0].as_py() << 32)
        return pa.table({"key": pa.array(mixed(whole).view(np.int64))})

    found = docs.mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(add, "key long")
    return build_bloom(found, "key")


def _hits(known, drop: int):
    def hits(keys: np.ndarray) -> np.ndarray:
        return known.value.holds(mixed(keys >> np.uint64(drop)))

    return hits


def _runs(docs: DataFrame, longest: int, hits, long_hits) -> DataFrame:
    """Sorted runs of each task's trie; words per language come as the empty phrase."""
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spilled(entries, names):
        """One sorted run per prefix partition and language of all entries taken out of the trie together."""
        runs: dict[tuple[int, str], list] = {}
        for packed, f in entries:
            own = [names[i] for i in np.frombuffer(packed, ">u4").tolist()]
            lang, words = own[0][0], [w for _, w in own]
            part = zlib.crc32(b" ".join([lang.encode(), *words[:_PREFIX]])) % parts
            runs.setdefault((part, lang), []).append((b" ".join(words), f))
        keys = sorted(runs)
        for at in range(0, len(keys), 50):
            some = [sorted(runs.pop(k)) for k in keys[at:at + 50]]
            phrases = pa.array([[p for p, _ in run] for run in some], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys[at:at + 50]], pa.int32()), pa.array([k[1] for k in keys[at:at + 50]]), phrases,
                pa.array([[f for _, f in run] for run in some], pa.list_(pa.int64()))], schema=_RUN)

    def count(batches):
        names, trie, totals = Vocabulary(), HatTrie(), {}
        for part in slices(batches, "text"):
            part = _Slice(part)
            if not part.n:
                continue
            for lang, c in zip(part.langs, np.bincount(part.lang, minlength=len(part.langs)).tolist()):
                totals[lang] = totals.get(lang, 0) + c
            for phrases, counts in part.phrases(longest, hits, long_hits, names):
                trie.add(phrases, counts)
            # word ids are dropped only with all of their phrases
            forget = len(names.names) > _MOST
            if trie.size > _MOST or forget:
                yield from spilled(trie.spill(0 if forget else _MOST // 2), names.names)
                names = Vocabulary() if forget else names
        yield from spilled(trie.spill(0), names.names)
        if totals:
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(totals), pa.int32()), pa.array(list(totals)), pa.array([[""]] * len(totals), pa.list_(pa.string())),
                pa.array([[c] for c in totals.values()], pa.list_(pa.int64()))], schema=_RUN)

    return docs.mapInArrow(count, "part int, lang string, phrases array<string>, f array<long>")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Runs merged per prefix partition and language: phrases found at least ``least`` times, and the empty one."""
    def merge(table: pa.Table) -> pa.Table:
        both = pa.table({"phrase": pa.concat_arrays([c.flatten() for c in table.column("phrases").chunks]),
                         "f": pa.concat_arrays([c.flatten() for c in table.column("f").chunks])})
        found = both.group_by("phrase").aggregate([("f", "sum")])
        found = found.filter(pa.compute.or_(pa.compute.greater_equal(found["f_sum"], least), pa.compute.equal(found["phrase"], "")))
        lang = pa.array([table.column("lang")[0].as_py()] * found.num_rows, pa.string())
        return pa.table({"lang": lang, "phrase": found["phrase"], "f": found["f_sum"]})

    return runs.groupBy("part", "lang").applyInArrow(merge, "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language, all phrases of 1 to ``longest`` words found at least ``least`` times within pieces: lang, phrase (words
    joined by blanks), f; the empty phrase has the number of all words.

    A-Z count as a-z. A null language is ``und``, null texts are empty; ids and other columns are not looked at, so repeated
    rows count again. An empty table gives no rows.
    """
    docs = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text"))
    spark = docs.sparkSession
    hits = _hits(shared(spark, _frequent(docs, least, lambda part: np.r_[part.keys, part.pairs[part.linked]])), _drop(spark))

    def long_keys(part):
        linked, out = part.frequent_links(hits), [np.zeros(0, np.uint64)]
        at = np.flatnonzero(linked)
        keys = part.pairs[at]
        for length in range(3, longest + 1):
            at, keys, _ = part.longer(at, keys, length, linked)
            out.append(keys)
        return np.concatenate(out)

    long_hits = _hits(shared(spark, _frequent(docs, least, long_keys)), _drop(spark)) if longest > 2 else None
    runs = _runs(docs, longest, hits, long_hits)
    return written(_merged(runs, least), "phrases")


def score(a: str, n: str, l: str, r: str) -> F.Column:
    """floor(1000 * a * n / (l * r)), exact for counts up to 10 ** 15."""
    a, n, l, r = (f"CAST({x} AS DECIMAL(15, 0))" for x in (a, n, l, r))
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {a} * {n}) div ({l} * {r})")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int = 2000,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by score.

    A phrase is cut in two where that scores lowest (ties: the shortest first part): ``l`` and ``r`` count the parts, ``n`` all words. Phrases
    inside a longer one that is found in at least ``covered`` percent of their places are left out; it is enough to look
    one word further, as counts never grow with length. Ranks go by score and count, descending, then phrase. Odd rows: see
    ``phrase_counts``.
    """
    counts = phrase_counts(docs, least, longest, text, lang)
    words = F.split("phrase", " ")
    found = counts.where("phrase <> ''").withColumn("w", words)
    candidates = found.where(F.size("w") > 1).select("lang", "phrase", F.col("f").alias("a"), "w")
    longer = candidates.where(F.size("w") > 2).select("lang", F.col("a").alias("whole"), F.explode(F.array(
        F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.expr(f"whole IS NULL OR 100 * whole < {covered} * a"))
    cut = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    n = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    parts = counts.select("lang", "phrase", "f")
    met = (cut.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
           .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
           .join(small(n, F.octet_length("lang") + 8), "lang"))
    lowest = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score("a", "n", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a language's best of 64 parts first, so no task gets all phrases of a language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
