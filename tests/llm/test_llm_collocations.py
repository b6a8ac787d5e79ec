"""Collocations against a plain version, the trie against a counter, and exact scores."""

import collections
import random

import helpers as H
import numpy as np
import pytest
from gleaner.llm import collocations
from gleaner.llm.collocations import HatTrie
from pyspark.sql import functions as F


def table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string")
    return df.withColumns({n: F.lit(1) for n in ("phrase", "f", "w", "n", "l", "r", "k", "first", "rest", "score", "rank", "prefix")})


def zipf_texts(seed, n, letters="abcdefghij"):
    rng = random.Random(seed)
    words = [a + b for a in letters for b in letters] + ["É", "naïve", "日本", "\x85x", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    seps = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", " ; ", "\x0b"]
    return [("".join(w + rng.choice(seps) for w in rng.choices(words, weights, k=rng.randint(0, 120))), rng.choice(["en", "fr", None, "und", ""]))
            for _ in range(n)]


@pytest.mark.parametrize("least,longest,covered,top", [(5, 5, 100, 2000), (3, 4, 60, 7), (2, 2, 100, 50), (1, 3, 100, 10_000)])
def test_collocations_equal_brute_force(spark, least, longest, covered, top):
    rows = zipf_texts(least, 150) + [(None, "en"), ("", None), (" .,; ", "fr"), ("the the the the the the the " * 30, "en"), ("x", None)]
    rows += rows[:20]
    got = collocations.collocations(table(spark, rows).repartition(7), least, longest, covered, top).collect()
    assert sorted(map(tuple, got)) == H.collocations(rows, least, longest, covered, top)


def test_a_long_text_and_a_hot_phrase(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300_000))
    rows = [(long, "en"), ("of the of the of the " * 5000, "en"), ("rare words here", "de")]
    got = collocations.collocations(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == H.collocations(rows)


def test_collocations_of_nothing(spark):
    got = collocations.collocations(table(spark, []))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
    assert collocations.collocations(table(spark, [(None, None), ("", "en")])).count() == 0


def test_trie_bursts_and_spills_sorted_runs():
    rng, trie, plain, runs = random.Random(8), HatTrie(burst=16), collections.Counter(), []
    for _ in range(40):
        phrases = [np.array([int(rng.paretovariate(1)) % 300 for _ in range(rng.randint(1, 5))], ">u4").tobytes() for _ in range(300)]
        counts = [rng.randint(1, 4) for _ in phrases]
        trie.add(phrases, counts)
        for p, c in zip(phrases, counts):
            plain[p] += c
        if trie.size > 1500:
            runs.append(list(trie.spill(700)))
            assert trie.size <= 700
    runs.append(list(trie.spill(0)))
    assert trie.size == 0 and not trie.root.below and len(runs) > 2
    merged = collections.Counter()
    for run in runs:
        trees = [p[:4] for p, _ in run]
        for first in set(trees):  # a subtree is whole and in order
            own = [p for p, _ in run if p[:4] == first]
            assert own == sorted(own) and trees.index(first) + len(own) == len(trees) - trees[::-1].index(first)
        for p, c in run:
            merged[p] += c
    assert merged == plain


def test_scores_are_exact(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(500):
        n = rng.randint(100, 10 ** rng.randint(3, 15))
        l, r = rng.randint(1, n), rng.randint(1, n)
        rows.append((rng.randint(1, min(l, r)), n, l, r))
    rows += [(10**15 - 1,) * 4, (1, 10**15 - 1, 1, 1), (7, 3, 3, 7)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    for a, n, l, r, s in df.withColumn("s", collocations.score("a", "n", "l", "r")).collect():
        assert s == 1000 * a * n // (l * r)
