"""Toxicity: a linear classifier whose scores may not depend on which group a text names.

Features are words and word beginnings, present or not. Identity terms of labelled texts are swapped for other terms of
their class; the fit minimises

    mean log loss + penalty * mean (margin(text) - margin(swapped text))^2 + l2 |w|^2

so weight that a group's name collected by accident of the sample is driven out and a neutral mention stays neutral.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import _MARK, Words, hash_of, shared, slices, utf8
from gleaner.session import written

#: Terms that name groups, by class; a term is swapped only within its class. A parameter everywhere.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("transgender", "cisgender"), ("immigrants", "natives", "refugees", "foreigners"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
BEGINNINGS = (4, 5, 6)  # lengths of word beginnings, in bytes


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Row, word and name of every feature of every word."""
    data, offsets = utf8(pa.array([t.lower() for t in texts], pa.string()))
    w = Words(data, offsets, _MARK)
    at = [np.arange(len(w.rows))]
    names = [w.hashes]
    for n in BEGINNINGS:
        longer = np.flatnonzero(w.ends - w.starts > n)
        at.append(longer)
        names.append(~w.of(w.starts[longer], w.starts[longer] + n))
    at = np.concatenate(at)
    return w.rows[at], at, np.concatenate(names), w


@dataclass
class Model:
    names: np.ndarray  # sorted feature names
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, _, names, _ = _features([t or "" for t in texts])
        at = _found(self.names, names)
        hit = at >= 0
        pairs = np.unique(rows[hit] * max(len(self.names), 1) + at[hit])
        margin = np.full(len(texts), self.bias)
        if len(pairs):
            margin += np.bincount(pairs // len(self.names), self.weights[pairs % len(self.names)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


_SIEVE: dict[int, np.ndarray] = {}


def _found(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Position of each name among the sorted known ones, or -1; a table of 18 bits clears most names first."""
    out = np.full(len(names), -1, np.int64)
    if not len(known):
        return out
    low = np.uint64((1 << 18) - 1)
    key = hash(known.tobytes())
    if key not in _SIEVE:
        _SIEVE.clear()
        table = np.zeros(1 << 18, bool)
        table[(known & low).astype(np.int64)] = True
        _SIEVE[key] = table
    maybe = np.flatnonzero(_SIEVE[key][(names & low).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, names[maybe]), len(known) - 1)
    same = known[at] == names[maybe]
    out[maybe[same]] = at[same]
    return out


def _counts(rows: DataFrame, least: int = 1) -> DataFrame:
    """Texts that hold each feature: (name, n)."""

    def count(batches):
        for part in slices(batches, "text"):
            at, _, names, _ = _features(part.column("text").to_pylist())
            order = np.lexsort((at, names))
            at, names = at[order], names[order]
            new = np.r_[True, (names[1:] != names[:-1]) | (at[1:] != at[:-1])] if len(names) else np.empty(0, bool)
            found, n = np.unique(names[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["name", "n"])

    return (rows.select("text").mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least))


def _swaps(identity) -> dict[int, list[int]]:
    """Feature names of each identity term -> the other terms of its class, by position in one list of terms."""
    flat = [t.lower() for group in identity for t in group]
    groups, at = {}, 0
    for group in identity:
        for i in range(len(group)):
            groups[at + i] = [at + j for j in range(len(group)) if j != i]
        at += len(group)
    return {"terms": flat, "hashes": hash_of(flat), "others": groups}


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic", identity=IDENTITY_TERMS, most_rows: int = 20_000, most_features: int = 4096,
          least: int = 5, penalty: float = 4.0, l2: float = 1e-4, seed: int = 7) -> Model:
    """Fit on labelled texts (``rows``, a condition on the label table's id column, if given).

    Labels 0 and 1 count; an id with several labels has the largest; null ids, labels and texts teach nothing. About
    ``most_rows`` labelled ids, chosen by a hash of the id, are used; features are the ``most_features`` with the highest
    log-likelihood ratio in at least ``least`` texts, plus all identity terms. Without both labels the
    model is constant (the share of label 1, or 0 without any).
    """
    spark = docs.sparkSession
    labels = labels.where(rows) if rows is not None else labels
    known = (labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).alias("y")))
    n = known.count()
    share = min(1.0, most_rows / max(n, 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by most_rows, so every task may hold it
    sample = docs.join(F.broadcast(known), docs[doc_id] == known["label_id"]).where(docs[text].isNotNull()).select(
        "label_id", "y", docs[text].alias("text"))
    sample = written(sample, "toxicity-sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        odds = 8.0 if n1 else -8.0
        return Model(np.empty(0, np.uint64), np.empty(0), odds)
    toxic, clean = (_counts(sample.where(F.col("y") == y), least=n).select("name", F.col("n").alias(f"n{y}")) for y, n in ((1, least), (0, 1)))
    both = toxic.join(clean, "name", "left").select("name", F.col("n1").cast("double").alias("a"), F.coalesce("n0", F.lit(0)).cast("double").alias("b"))
    # all features are ranked; the best come to the driver
    useful = both.withColumn("gain", _likelihood_gain(F.col("a"), F.col("b"), n1, n0)).where((F.col("a") / n1 > F.col("b") / n0) & (F.col("gain") > 10))
    chosen = useful.orderBy(F.desc("gain"), "name").limit(most_features).select("name").toArrow().column("name").to_numpy().view(np.uint64)
    swaps = _swaps(identity)
    vocabulary = np.unique(np.concatenate([chosen, swaps["hashes"]]))
    x, y, changes = _matrix(sample, vocabulary, swaps, seed)
    weights, bias = _fit(x, y, changes, len(vocabulary), penalty, l2)
    return Model(vocabulary, weights, bias)


def _likelihood_gain(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Log-likelihood ratio of "present" (in a of n1 and b of n0 texts) against the label."""
    def part(k, n):
        p = F.least(F.greatest(k / F.lit(float(n)), F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.ln(p) + (F.lit(float(n)) - k) * F.ln(1 - p)

    return 2 * (part(a, n1) + part(b, n0) - part(a + b, n1 + n0))


def _matrix(sample: DataFrame, vocabulary: np.ndarray, swaps: dict, seed: int):
    """Vocabulary positions of every sampled text, its label, and the change of positions by the swap.

    At most ``most_rows`` short lists reach the driver.
    """
    tools = shared(sample.sparkSession, (vocabulary, swaps))
    sets = pa.list_(pa.int32())

    def vectors(batches):
        vocabulary, swaps = tools.value
        order = np.argsort(swaps["hashes"])
        ranked = swaps["hashes"][order]
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            _, _, _, w = _features(texts)
            at = np.minimum(np.searchsorted(ranked, w.hashes), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == w.hashes) if len(ranked) else np.empty(0, np.int64)
            term = order[at[hit]]
            hit, term = hit[[bool(swaps["others"][t]) for t in term]], term[[bool(swaps["others"][t]) for t in term]]
            changed: dict[int, list] = {}
            for k, (i, t) in enumerate(zip(hit.tolist(), term.tolist())):
                others = swaps["others"][t]
                changed.setdefault(int(w.rows[i]), []).append((i, others[(seed + k) % len(others)]))
            base, swapped = _positions(texts, vocabulary), [None] * len(texts)
            if changed:
                made = []
                for row, edits in changed.items():
                    low = texts[row].lower().encode()
                    begin = int(w.offset(row))
                    out, last = [], 0
                    for i, other in edits:
                        out += [low[last:w.starts[i] - begin], swaps["terms"][other].encode()]
                        last = w.ends[i] - begin
                    made.append(b"".join([*out, low[last:]]).decode())
                for row, positions in zip(changed, _positions(made, vocabulary)):
                    swapped[row] = positions
            yield pa.RecordBatch.from_arrays(
                [part.column("label_id"), part.column("y"), pa.array(base, sets), pa.array(swapped, sets)],
                names=["label_id", "y", "base", "swapped"])

    schema = f"label_id {sample.schema['label_id'].dataType.simpleString()}, y {sample.schema['y'].dataType.simpleString()}"
    rows = sample.mapInArrow(vectors, f"{schema}, base array<int>, swapped array<int>").collect()
    rows.sort(key=lambda r: (str(r["label_id"]), r["base"]))
    x = (np.concatenate([np.full(len(r["base"]), i) for i, r in enumerate(rows)]).astype(np.int64),
         np.concatenate([np.asarray(r["base"], np.int64) for r in rows]))
    pairs = [(np.asarray(r["base"], np.int64), np.asarray(r["swapped"], np.int64)) for r in rows if r["swapped"] is not None]
    none = np.empty(0, np.int64)
    changes = (np.concatenate([none, *(np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs))]).astype(np.int64),
               np.concatenate([none, *(np.r_[a, b] for a, b in pairs)]).astype(np.int64),
               np.concatenate([np.empty(0), *(np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs)]), len(pairs))
    return x, np.array([r["y"] for r in rows], np.float64), changes


def _positions(texts: list[str], vocabulary: np.ndarray) -> list[list[int]]:
    rows, _, names, _ = _features(texts)
    at = _found(vocabulary, names)
    hit = at >= 0
    pairs = np.unique(rows[hit] * len(vocabulary) + at[hit])
    cuts = np.searchsorted(pairs // len(vocabulary), np.arange(len(texts) + 1))
    return [(pairs[a:b] % len(vocabulary)).tolist() for a, b in zip(cuts, cuts[1:])]


def _fit(x, y, changes, size, penalty, l2, rounds: int = 400, rate: float = 0.1):
    """Adam over the whole (bounded) sample; both labels weigh the same."""
    rows, cols = x
    c_rows, c_cols, c_signs, n_changes = changes
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        margin = w[-1] + np.bincount(rows, w[cols], minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        gradient = np.append(np.bincount(cols, error[rows], minlength=size), error.sum())
        gradient[:-1] += 2 * l2 * w[:-1]
        if n_changes:
            change = np.bincount(c_rows, c_signs * w[c_cols], minlength=n_changes)
            gradient[:-1] += 2 * penalty / n_changes * np.bincount(c_cols, c_signs * change[c_rows], minlength=size)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns plus a score from 0 to 1 of the whole text.

    Null and empty texts get the score of a text without features; repeated rows, null ids and other columns don't
    matter, a column called ``name`` is replaced; an empty table gives an empty one.
    """
    tool = shared(docs.sparkSession, model)
    kept = [c for c in docs.columns if c != name]

    def judge(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(tool.value.scores(part.column(text).to_pylist()))],
                names=[*kept, name])

    rows = docs.select(*kept)
    return rows.mapInArrow(judge, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
