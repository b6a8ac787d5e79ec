"""Token counts of a byte-level BPE at every prefix.

With ``last(i)`` the last token of the first i bytes of a pre-split word, found by the automaton of ``bpe``,

    count(i) = count(i - len(last(i))) + 1

One walk over a word gives the counts of all its prefixes, and words never merge with each other, so the counts of a text are
those of its words on top of each other. They are stored for every prefix; truncation and budget questions are look-ups in
the stored column and no text is encoded again. Where a prefix is pre-split otherwise than the whole text, the count
stored is the prefix's own: a run of white space whose last blank went to the next word, a contraction cut in two, and
a special string cut in two, whose front is ordinary text.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.bpe import Codec
from gleaner.llm.common import slices

_KEPT = 400_000  # words remembered by one worker process
_LONG = 200  # longer words are not remembered


class PrefixCounter:
    """Counts for one vocabulary file (``tokenizers`` format, byte-level BPE without normaliser)."""

    def __init__(self, path: str):
        self.codec = Codec(path)
        self.runs = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
        self.solid = regex.compile(r"[\p{L}\p{N}]")
        self.memory: dict[str, bytes] = {}

    def word(self, piece: str) -> bytes:
        """Counts of the prefixes of 1, 2, .. characters of one word as packed 32-bit numbers, remembered."""
        got = self.memory.get(piece)
        if got is None:
            data = piece.encode()
            counts = self.codec.automaton.counts(data)
            if len(data) != len(piece):
                counts = [c for c, b in zip(counts, data) if b & 0xC0 != 0x80] + [counts[-1]]
            if piece in ("'re", "'ve", "'ll"):  # cut after the first letter it is no contraction
                counts[2] = 2
            got = array("i", counts[1:]).tobytes()
            if len(piece) < _LONG:
                if len(self.memory) >= _KEPT:
                    self.memory.clear()
                self.memory[piece] = got
        return got

    def _plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes of a text without special strings, as the whole text is pre-split."""
        names = self.codec.pieces.findall(text)
        known = self.memory.get
        inside = np.frombuffer(b"".join([known(p) or self.word(p) for p in names]), np.int32)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        totals = inside[np.cumsum(lengths) - 1].astype(np.int64)
        out = np.zeros(len(text) + 1, np.int64)
        out[1:] = inside + np.repeat(np.cumsum(totals) - totals, lengths)
        for m in self.runs.finditer(text):
            out[m.end()] = out[m.start()] + np.frombuffer(self.word(m.group()), np.int32)[-1]
        return out

    def _front(self, text: str, at: int, to: int, done: np.ndarray) -> list[int]:
        """Counts of the prefixes that end inside the special string at ``text[at:to]``, after ``done`` for the stretch before it."""
        start = at - (len(done) - 1)
        safe = at
        while safe > start and not self.solid.match(text[safe - 1]):
            safe -= 1
        out = []
        for end in range(at + 1, to):
            out.append(int(done[safe - start] + self._plain(text[safe:end])[-1]))
        return out

    def counted(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to all."""
        out, base, before = [np.zeros(1, np.int64)], 0, np.zeros(1, np.int64)
        for at, to, special in self.codec.segments(text):
            if special is None:
                before = self._plain(text[at:to])
                out.append(before[1:] + base)
            else:
                front = np.array(self._front(text, at, to, before), np.int64) + base
                base += int(before[-1]) + 1
                out.append(np.r_[front, base])
                before = np.zeros(1, np.int64)
        return np.concatenate(out)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def truncated(counts: Column, to: Column) -> Column:
    """Tokens of the first ``to`` characters, looked up in a stored column of counts; beyond the text, those of all of it."""
    return counts[F.least(to.cast("int"), F.size(counts) - 1)]


def fitting(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, looked up in a stored column of counts."""
    return F.size(counts) - 1 - F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True) + 1


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 budgets: tuple[int, ...] = (), prefixes: bool = False) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, for each budget (0 or more) the longest prefix that fits (characters), and,
    if asked for, the stored counts (``prefix_counts``: the tokens of the first 0, 1, .. characters).

    ``path`` is the vocabulary file, readable on every executor. Null and empty texts have 0 tokens; null ids and
    repeated rows are kept as they are, other columns are not looked at; an empty table gives an empty one. Texts and words
    of any length take linear time.
    """
    id_type = docs.schema[doc_id].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType(), False),
              T.StructField("n_tokens", T.LongType(), False)]
    fields += [T.StructField(f"fits_{b}", T.LongType(), False) for b in budgets]
    if prefixes:
        fields.append(T.StructField("prefix_counts", T.ArrayType(T.LongType(), False), False))

    def count(batches):
        tool = counter(path)
        for part in slices(batches, "text"):
            sizes, totals, fitted, kept = [], [], [[] for _ in budgets], []
            for value in part.column("text").to_pylist():
                value = value or ""
                counts = tool.counted(value)
                sizes.append(len(value.encode()))
                totals.append(int(counts[-1]))
                for out, b in zip(fitted, budgets):
                    # counts may fall inside a word, so it is the last place and not the first beyond
                    out.append(len(value) if counts[-1] <= b else int(np.flatnonzero(counts <= b)[-1]))
                if prefixes:
                    kept.append(counts)
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()),
                       *(pa.array(x, pa.int64()) for x in fitted)]
            if prefixes:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(count, T.StructType(fields))
