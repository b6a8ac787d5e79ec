"""Byte-level BPE by a tokenization automaton.

The automaton's arcs carry tokens; it accepts exactly the token sequences that BPE makes of some string, so every string
has one path. It starts as one state with a loop per byte. Each merge (u, v), in order, is applied by a gadget: with q
the state that arcs ``u`` lead to and r the state behind ``v`` from there,

* a copy q' of q without the arc ``v`` takes over all arcs ``u`` (after ``u`` no ``v`` may follow any more);
* every state with an arc ``u`` gets an arc ``uv`` to r.

All arcs of one label lead to one state, and a state differs from the one it was copied from by one arc. So a state is
stored as its label, its number (the merge that made it) and the state its label led to before any split; the arcs follow from the
gadgets: ``t`` leaves a state unless one of the gadgets that formed the state had removed ``t``, or, for arcs that came later,
the token that ``t`` grew from. ``Automaton.step`` looks that up once per (state, token) and keeps it in the transition table.

A pre-split word is encoded by one walk over its bytes: the arcs whose labels end at a byte are tried from states that
are already reached; exactly one fits, as every prefix has one path. The walk therefore also knows the number of tokens of
every prefix. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import itertools
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.llm.common import slices

# fixed values: the cut pattern of byte-level BPE vocabularies of this kind
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_KEPT = 400_000  # words, and transitions times ten, remembered by one worker process
_LONG = 200  # longer words are not remembered
_BITS = 24


def visible_bytes() -> dict[str, int]:
    """The letter that stands for each byte in such vocabulary files: itself if printable, else the next free one."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(free)] = b
            free += 1
    return out


class Automaton:
    """States and arcs of a list of merges over byte tokens.

    ``merges`` are (left, right, result) in order; tokens are any ids below 2 ** 24, ``single`` gives the id of each byte.
    """

    def __init__(self, single: list[int], merges: list[tuple[int, int, int]]):
        size = max(single + [m[2] for m in merges]) + 1
        self.labels: list[bytes] = [b""] * size
        self.born, self.left = [0] * size, [-1] * size
        self.behind = [-1] * size  # the state that arcs of a token lead to
        self.before = [-1] * size  # and led to before any split
        self.label = [-1]  # the token whose arcs lead to a state; state 0 is the start
        self.gadgets: dict[int, int] = {}  # (u, v) -> state
        self.table: dict[int, bool] = {}
        for b, t in enumerate(single):
            self.labels[t], self.behind[t], self.before[t] = bytes([b]), 0, 0
        for u, v, made in merges:
            if self.behind[made] >= 0:
                raise ValueError("every merge has to make a token of its own")
            self._gadget(u, v, made)
        self.table.clear()
        self.arcs = ahocorasick.Automaton()
        for t, name in enumerate(self.labels):
            if name:
                self.arcs.add_word(name.decode("latin-1"), t)
        self.arcs.make_automaton()
        self.sizes = [len(name) for name in self.labels]

    def _gadget(self, u: int, v: int, made: int) -> None:
        q, state = self.behind[u], len(self.label)
        self.label.append(u)
        # a merge of tokens that never stand side by side changes nothing
        if q >= 0 and self.behind[v] >= 0 and self._leaves(q, v):
            self.labels[made], self.left[made], self.born[made] = self.labels[u] + self.labels[v], u, state
            self.behind[made] = self.before[made] = self.behind[v]
            self.gadgets[u << _BITS | v] = state
            self.behind[u] = state

    def _leaves(self, state: int, t: int) -> bool:
        """Whether an arc ``t`` leaves the state."""
        removed, born, left = self.gadgets.get, self.born, self.left
        while state:
            u = self.label[state]
            grown, limit = t, state  # the arc as the gadgets up to ``limit`` knew it
            while grown >= 0:
                gone = removed(u << _BITS | grown)
                if gone is not None and gone <= limit:
                    return False
                limit = min(limit, born[grown])
                grown = left[grown]
            state = self.before[u]
        return True

    def step(self, state: int, t: int) -> bool:
        """``_leaves``, from the transition table."""
        key = state << _BITS | t
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= 10 * _KEPT:
                self.table.clear()
            got = self.table[key] = self._leaves(state, t)
        return got

    def walk(self, word: bytes) -> list[int]:
        """The last token of every prefix, by prefix length (0: -1)."""
        states, last = [-1] * (len(word) + 1), [-1] * (len(word) + 1)
        states[0] = 0
        sizes, behind, known, step, bits = self.sizes, self.behind, self.table.get, self.step, _BITS
        for end, t in self.arcs.iter(word.decode("latin-1")):
            end += 1
            if states[end] < 0:
                state = states[end - sizes[t]]
                fits = known(state << bits | t)
                if fits or fits is None and step(state, t):
                    states[end], last[end] = behind[t], t
        return last

    def counts(self, word: bytes) -> list[int]:
        """The number of tokens of every prefix, by prefix length."""
        out, sizes = [0], self.sizes
        for end, t in enumerate(self.walk(word)[1:], 1):
            out.append(out[end - sizes[t]] + 1)
        return out

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        last, sizes = self.walk(word), self.sizes
        out, end = [], len(word)
        while end:
            t = last[end]
            out.append(t)
            end -= sizes[t]
        out.reverse()
        return out


class Codec:
    """A vocabulary file (``tokenizers`` format, byte-level BPE without normaliser) with its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normaliser is needed")
        visible, vocab = visible_bytes(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton([vocab[c] for c in sorted(visible, key=visible.get)],
                                   [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.labels = dict(enumerate(self.automaton.labels)) | {i: s.encode() for s, i in self.special.items()}
        self.memory: dict[str, bytes] = {}

    def segments(self, text: str):
        """(start, end, id) of the stretches between special strings, id None, and of these strings."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if at < m.start():
                yield at, m.start(), None
            yield m.start(), m.end(), self.special[m.group()]
            at = m.end()
        if at < len(text):
            yield at, len(text), None

    def word(self, piece: str) -> bytes:
        """Tokens of one pre-split word as packed 32-bit numbers, remembered."""
        got = self.memory.get(piece)
        if got is None:
            got = array("i", self.automaton.encode(piece.encode())).tobytes()
            if len(piece) < _LONG:
                if len(self.memory) >= _KEPT:
                    self.memory.clear()
                self.memory[piece] = got
        return got

    def packed(self, text: str) -> bytes:
        """Tokens of a text as packed 32-bit numbers."""
        out, known = [], self.memory.get
        for at, to, special in self.segments(text):
            if special is not None:
                out.append(np.int32(special).tobytes())
            else:
                out += [known(p) or self.word(p) for p in self.pieces.findall(text[at:to])]
        return b"".join(out)

    def decode(self, ids) -> str:
        """Text of tokens; ids that are not in the vocabulary emit nothing, broken UTF-8 gives U+FFFD."""
        labels = self.labels
        return b"".join([labels.get(i, b"") for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One automaton per worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``ids``, the tokens of its whole text.

    ``path`` is the vocabulary file, readable on every executor. Null and empty texts have no tokens; null ids and repeated rows
    are kept as they are, other columns are not looked at; an empty table gives an empty one. Texts of any
    length are walked in linear time.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def encode(batches):
        tool = codec(path)
        for part in slices(batches, "text"):
            rows = [tool.packed(t) if t else b"" for t in part.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(encode, schema)


def decoded(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: ``doc_id``, ``ids`` and ``text``, what the tokens spell; a null list spells the empty text."""
    schema = T.StructType([T.StructField("doc_id", tokens.schema[doc_id].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType(), False)])

    def decode(batches):
        tool = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                lists = part.column("ids")
                flat = lists.flatten().to_numpy().tolist()
                sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()
                ends = itertools.accumulate(sizes)
                texts = [tool.decode(flat[end - size:end]) for end, size in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select(tokens[doc_id].alias("doc_id"), tokens[ids].cast("array<int>").alias("ids")).mapInArrow(decode, schema)
