"""Personal data: patterns, and terms that give protected entities away.

The patterns find the protected entities (addresses, numbers). Information-theoretic sanitisation then asks how
much a term near an entity tells about it. With counts over all word positions of the corpus,

    disclosure(entity; term) = PMI(entity, term) / information(entity)
                             = log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

is 1 for a term met only beside the entity and falls the more the term is used elsewhere. Terms are removed from
``remove_at`` on and generalised to their kind from ``generalise_at`` on, wherever they stand. An entity of one text
is given away by what stands beside it there; beside an entity of several texts a term needs two different contexts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import _MARK, Words, build_bloom, free_names, shared, slices, utf8, whole_text
from gleaner.session import written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile("[0-9]")
# each takes a whole run at once, so that long runs cost their length only
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, ordered by start, then kind; failing matches are dropped."""
    found: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") >= 3:
                parts, start = m.group().split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[i:i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts[i:i + 4]):
                        found.append((start, 1, end))
                    start = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entity(kind: str, value: str) -> int:
    """64-bit name of an entity; spelling variants of numbers are one."""
    value = value.lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else "[^0-9]", "", value)
    return xxhash.xxh3_64_intdigest(f"{kind} {value}".encode())


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def row_key(text: str) -> Column:
    """Second half of a row's key beside its id: rows alike in both are one document."""
    return F.xxhash64(whole_text(text))


def _contexts(docs: DataFrame, near: int) -> DataFrame:
    """Terms at most ``near`` words from an entity: (entity, term, context, doc), and per occurrence one row without term."""

    def find(batches):
        for part in slices(batches, "text"):
            sides, owners = [], []
            for value, doc in zip(part.column("text").to_pylist(), part.column("doc").to_pylist()):
                for kind, start, end in base_spans(value or ""):
                    left, right = value[max(0, start - 40 * near):start], value[end:end + 40 * near]
                    context = xxhash.xxh3_64_intdigest((left + "\0" + right).encode())
                    entity = _entity(kind, value[start:end])
                    owners += [(entity, context, doc, True), (entity, context, doc, False)]
                    # a word cut by the end of the window is no word
                    sides += [left[left.find(" ") + 1:] if start > 40 * near else left,
                              right[:right.rfind(" ") + 1] if end + 40 * near < len(value) else right]
            if not owners:
                continue
            data, offsets = utf8(pa.array(sides, pa.string()))
            w = Words(data, offsets, _MARK)
            first = np.searchsorted(w.rows, np.arange(len(sides)))
            count = np.bincount(w.rows, minlength=len(sides))
            place = np.arange(len(w.rows)) - first[w.rows]
            left = np.array([o[3] for o in owners])[w.rows]
            keep = np.where(left, place >= count[w.rows] - near, place < near) & (w.ends - w.starts >= 3)
            names, texts = np.array([o[0] for o in owners], np.uint64), np.array([o[1] for o in owners], np.uint64)
            docs_ = np.array([o[2] for o in owners], np.int64)
            rows, terms = w.rows[keep], w.hashes[keep]
            # a term counts once for an occurrence of an entity, and each occurrence gives one row of its own
            _, one = np.unique(np.stack([rows.astype(np.uint64) >> np.uint64(1), terms]), axis=1, return_index=True)
            rows, terms = rows[one], terms[one]
            yield pa.RecordBatch.from_arrays(
                [_signed(np.r_[names[rows], names[::2]]),
                 pa.concat_arrays([_signed(terms), pa.nulls(len(names) // 2, pa.int64())]),
                 _signed(np.r_[texts[rows], texts[::2]]), pa.array(np.r_[docs_[rows], docs_[::2]])],
                names=["entity", "term", "context", "doc"])

    return docs.select("text", F.xxhash64("text").alias("doc")).mapInArrow(find, "entity long, term long, context long, doc long")


def disclosing_terms(docs: DataFrame, near: int = 6, support: int = 2, generalise_at: float = 0.9,
                     remove_at: float = 0.97) -> DataFrame:
    """Terms over the threshold: (term, disclosure, removed).

    ``docs`` has a text. A pair counts if term and entity meet in at least ``support`` different places (contexts by
    text, so copies of one text count once), or in as many as the entity has texts if these are fewer: rare entities
    lose no term to it.
    """
    spark = docs.sparkSession
    # distinct places first: copies fold before the shuffle, and the grouping on the pair stays small for hot pairs
    met = written(_contexts(docs, near).groupBy("entity", "term", "context", "doc").agg(F.count("*").alias("n")), "contexts")
    entities = met.where("term is null").groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count_distinct("doc").alias("texts"))
    pairs = (met.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("places"), F.sum("n").alias("both"))
             .join(entities, "entity").where(F.col("places") >= F.least(F.lit(support), F.col("texts"))))
    # a common word meets many entities, but the same counts again and again
    pairs = written(pairs.select("term", "both", "n_entity").distinct(), "pairs")
    wanted = shared(spark, build_bloom(pairs.select("term"), "term", 18))

    def count(batches):
        """Occurrences of candidates per slice, and of all words (no term)."""
        for part in slices(batches, "text"):
            w = Words(*utf8(part.column("text")), _MARK)
            found, n = np.unique(w.hashes[wanted.value.holds(w.hashes)], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([_signed(found), pa.nulls(1, pa.int64())]), pa.array(np.r_[n, len(w.rows)].astype(np.int64))],
                names=["term", "n"])

    counts = written(docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term")),
                     "term-counts")
    total = counts.where("term is null").first()
    n = F.lit(float(max(total["n_term"] if total else 0, 2)))
    disclosure = F.least(F.lit(1.0), F.log(F.col("both") * n / (F.col("n_entity") * F.col("n_term")))
                         / F.log(F.greatest(n / F.col("n_entity"), F.lit(1.0000001))))
    terms = pairs.join(counts, "term").groupBy("term").agg(F.max(disclosure).alias("disclosure"))
    return written(terms.where(F.col("disclosure") >= generalise_at).withColumn("removed", F.col("disclosure") >= remove_at), "terms")


def places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, row_key, term, start, end) of the words that may be among the terms, in characters."""
    wanted = shared(docs.sparkSession, build_bloom(terms.select("term"), "term", 16))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def look(batches):
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            w = Words(data, offsets, _MARK)
            hit = np.flatnonzero(wanted.value.holds(w.hashes))
            if not len(hit):
                continue
            heads = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
            rows = w.rows[hit]
            base = heads[offsets[rows]]
            ids = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(ids), part.column("row_key").take(ids), _signed(w.hashes[hit]),
                 pa.array(heads[w.starts[hit]] - base), pa.array(heads[w.ends[hit]] - base)],
                names=["doc_id", "row_key", "term", "start", "end"])

    return docs.mapInArrow(look, f"doc_id {id_type}, row_key long, term long, start long, end long")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), row_key(text).alias("row_key"), whole_text(text).alias("text"))


def _hits(docs: DataFrame, **settings) -> DataFrame:
    """Places of disclosing terms, one row per document that has some."""
    terms = disclosing_terms(docs, **settings)
    return written(places(docs, terms).join(terms, "term").groupBy("doc_id", "row_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "removed"))).alias("hits")), "hits")


def _all_spans(text: str, hits) -> tuple[list, list]:
    """Base spans, and all spans with a replacement; terms that touch a base span are left to it."""
    base = base_spans(text)
    out = [(s, KINDS.index(k), e, f"[{k.upper()}]") for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    for hit in hits or ():
        start, end = hit["start"], hit["end"]
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            shape = "[NUMBER]" if text[start:end].isdigit() else "[NAME]" if text[start].isupper() else "[WORD]"
            out.append((start, 4, end, "" if hit["removed"] else shape))
    return base, sorted(out)


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row: id, counts per kind, sha256 of the base spans, all spans as text, number of term spans.

    Null and empty texts have no spans; rows alike in id and text get the same result, null ids included; other
    columns are not looked at; an empty table gives an empty one.
    """
    keyed = _keyed(docs, doc_id, text)
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    hits = _hits(keyed, **settings)
    plain = keyed.mapInArrow(_base, f"doc_id {id_type}, row_key long, base array<struct<kind:int,start:long,end:long>>")
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), "hits")
    both = plain.join(hits, plain.doc_id.eqNullSafe(hits.hit_id) & (plain.row_key == hits.hit_key), "left")
    kinds = F.array(*map(F.lit, KINDS))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")

    clear = F.filter(F.coalesce("hits", F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>")),
                     lambda h: ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    merged = F.array_sort(F.concat(
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))),
        F.transform(clear, lambda h: F.struct(h["start"].alias("start"), F.lit(4).alias("kind"), h["end"].alias("end")))))

    def count(i):
        # a second parameter of the lambda, default or not, would be the place in the array
        return F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return both.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
                       text_of(merged).alias("spans"), F.size(clear).cast("long").alias("n_term"))


def _base(batches):
    kind_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in slices(batches, "text"):
        spans = [[{"kind": KINDS.index(k), "start": s, "end": e} for k, s, e in base_spans(t)]
                 for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(spans, kind_type)],
                                         names=["doc_id", "row_key", "base"])


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced by its kind and disclosing terms
    generalised or removed. Texts without findings, null among them, stay as they are."""
    hit_id, hit_key, found = free_names(docs, "__hit_id", "__hit_key", "__hits")
    hits = _hits(_keyed(docs, doc_id, text), **settings)
    hits = hits.select(F.col("doc_id").alias(hit_id), F.col("row_key").alias(hit_key), F.col("hits").alias(found))
    both = docs.join(hits, docs[doc_id].eqNullSafe(hits[hit_id]) & (row_key(text) == hits[hit_key]), "left")
    names = docs.columns
    both = both.select(*names, found)

    def clean(batches):
        for part in slices(batches, text):
            made = []
            for value, hits in zip(part.column(text).to_pylist(), part.column(found).to_pylist()):
                if value:
                    out, at = [], 0
                    for start, _, end, put in _all_spans(value, hits)[1]:
                        if start >= at:
                            out += [value[at:start], put]
                        at = max(at, end)
                    value = "".join([*out, value[at:]]) if out else value
                made.append(value)
            column = pa.array(made, part.schema.field(text).type)
            yield pa.RecordBatch.from_arrays(
                [column if n == text else part.column(n) for n in names], names=names)

    return both.mapInArrow(clean, docs.schema)


def sha256_of(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
