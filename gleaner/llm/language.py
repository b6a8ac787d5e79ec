"""Language by rank-order profiles: the most frequent n-grams of a text against those of each language.

Letters of a text are lower-cased, everything else is a word boundary; n-grams of one to three characters, boundaries
included, are ranked by count. The out-of-place distance adds up how far each n-gram's rank in the text is from its rank
in the profile, or the profile's length where it is missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import mixed, shared, slices

_CODE = 40  # bits of an n-gram's name
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with one 0 for each run of other characters, and the text of each."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(lower) + 1), [1, *(len(t) + 1 for t in lower)])
    rows = np.minimum(rows, len(lower)) - 1
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]  # one boundary before and one after each word; runs of more fold below
    points, rows, letter = np.where(letter, points, 0)[keep].astype(np.uint64), rows[keep], letter[keep]
    return points, rows


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text and 40-bit name of every n-gram (1 to 3 characters, within one word and its boundaries)."""
    p, rows = _spelled(texts)
    one = np.flatnonzero(p)
    if not len(one):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    step = np.uint64(21)
    before, after = p[one - 1], p[np.minimum(one + 1, len(p) - 1)]
    here = p[one]
    has_next = after > 0
    tag = np.uint64(1) << np.uint64(63)
    second = (before << step) | here  # ends at this letter
    closing = one[~has_next]
    names = [here + tag, second + (tag >> np.uint64(1)),
             (p[closing] << step) + (tag >> np.uint64(1)),  # last letter and boundary
             (before << step << step) | (here << step) | after]
    owner = [one, one, closing, one]
    shift = np.uint64(64 - _CODE)
    return rows[np.concatenate(owner)], mixed(np.concatenate(names)) >> shift


def profiles(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", length: int = 300,
             most_languages: int = 1000) -> dict[str, np.ndarray]:
    """The ``length`` most frequent n-grams of each language over all rows where ``train`` holds, in order.

    Rows without language or letters teach nothing. Counting is done per slice and then by a grouping on language and
    n-gram; the driver gets ``length`` names for each of at most ``most_languages`` languages.
    """

    def count(batches):
        for part in slices(batches, "text"):
            texts, langs = part.column("text").to_pylist(), part.column("lang")
            kinds = langs.unique()
            for name in kinds:
                chosen = np.flatnonzero(np.asarray(pa.compute.equal(langs, name)))
                words: dict[str, int] = {}
                for i in chosen:
                    for w in texts[i].split():
                        words[w] = words.get(w, 0) + 1
                at, codes = ngrams(list(words))
                if not len(codes):
                    continue
                weights = np.fromiter(words.values(), np.float64, len(words))
                names, where = np.unique(codes, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(names), pa.string()), pa.array(names.astype(np.int64)),
                     pa.array(np.bincount(where, weights[at]).astype(np.int64))], names=["lang", "ngram", "n"])

    rows = docs.where(train & docs[lang].isNotNull() & docs[text].isNotNull()).select(
        docs[text].alias("text"), docs[lang].alias("lang"))
    counts = rows.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    found = top.limit(length * most_languages + 1).collect()
    if len(found) > length * most_languages:
        raise ValueError(f"more than {most_languages} languages; merge rare values of {lang!r} first")
    out: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["ngram"])
    return {k: np.array(v, np.uint64) for k, v in out.items()}


class Ranker:
    """Out-of-place distances to a set of profiles, for many texts at once."""

    def __init__(self, known: dict[str, np.ndarray], length: int = 300):
        self.names, self.length = sorted(known), length
        self.ngrams = np.unique(np.concatenate([*known.values(), np.empty(0, np.uint64)]))
        self.ranks = np.full((len(self.ngrams) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.ngrams, known[name]), j] = np.arange(len(known[name]))

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Nearest language of each text, ties to the smaller name, and 1 - distance / greatest possible distance."""
        rows, codes = ngrams([t or "" for t in texts])
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not len(codes) or not self.names:
            return best, score
        keys = np.sort((rows.astype(np.uint64) << np.uint64(_CODE)) | codes)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[first], np.diff(np.r_[first, len(keys)])
        rows = (keys >> np.uint64(_CODE)).astype(np.int64)
        # rank by falling count, then by name: one sort, row in the upper bits
        low = np.uint64(20)
        begin = np.searchsorted(rows, np.arange(len(texts)))
        place = np.arange(len(keys)) - begin[rows]
        if max(np.max(place), np.max(n)) < 1 << 20 and len(texts) < 1 << 24:
            few = np.uint64(0xFFFFF) - n.astype(np.uint64)
            packed = np.sort((rows.astype(np.uint64) << (low + low)) | (few << low) | place.astype(np.uint64))
            rows = (packed >> (low + low)).astype(np.int64)
            order = begin[rows] + (packed & np.uint64(0xFFFFF)).astype(np.int64)
        else:
            order = np.lexsort((place, -n, rows))
            rows = rows[order]
        keys = keys[order]
        rank = np.arange(len(rows)) - begin[rows]
        keep = rank < self.length
        rows, rank = rows[keep], rank[keep]
        codes = keys[keep] & np.uint64((1 << _CODE) - 1)
        at = np.minimum(np.searchsorted(self.ngrams, codes), len(self.ngrams) - 1)
        at = np.where(self.ngrams[at] == codes, at, len(self.ngrams))
        there = self.ranks[at]
        away = np.where(there >= 0, np.abs(there - rank[:, None]), self.length)
        used = np.bincount(rows, minlength=len(texts))
        far = np.stack([np.bincount(rows, away[:, j], minlength=len(texts)) for j in range(len(self.names))], axis=1)
        near = far.argmin(axis=1)
        for i in np.flatnonzero(used):
            best[i] = self.names[near[i]]
            score[i] = 1 - far[i, near[i]] / (used[i] * self.length)
        return best, score


def predicted(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text", length: int = 300,
              names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns, with the nearest language and a score from 0 to 1 added.

    A null text or one without letters is ``und`` with score 0, and so is every text if no language was learned.
    Rows are judged one by one, so repeated rows, null ids and other columns don't matter; columns of the
    given names are replaced.
    """
    ranker = shared(docs.sparkSession, Ranker(known, length))
    kept = [c for c in docs.columns if c not in names]

    def judge(batches):
        for part in slices(batches, text, 1 << 20):
            best, score = ranker.value.judge(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(best, pa.string()), pa.array(score)], names=[*kept, *names])

    rows = docs.select(*kept)
    schema = T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(judge, schema)
