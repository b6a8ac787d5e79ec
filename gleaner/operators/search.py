"""Retrieval for a table of questions: exact vector top-k, all-terms match, rank fusion, notice search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import predicates as P
from gleaner.operators.bounds import fits
from gleaner.session import written

_QUESTION_ROWS = 4096  # most questions held by every task; more go through the block join
_BLOCK_ROWS = 8192


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two float arrays, in double arithmetic."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0),
                           lambda acc, v: acc + v)

    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column):
    flat = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(question_ids, questions, ids, vectors, k, limit, types):
    """The k nearest rows per question of one block, ties by id, as a record batch."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = questions / np.linalg.norm(questions, axis=1, keepdims=True)
        v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        # rounding makes the order independent of how rows were blocked
        distance = np.round(1.0 - q @ v.T, 12)
    id_values = np.array(ids.to_pylist(), dtype=object if pa.types.is_string(types[1]) else None)
    picked_q, picked_v = [], []
    for i, row in enumerate(distance):
        near = np.flatnonzero(row < limit) if limit is not None else np.flatnonzero(~np.isnan(row))
        if len(near) > k:
            near = near[row[near] <= np.partition(row[near], k - 1)[k - 1]]
        near = near[np.lexsort((id_values[near], row[near]))[:k]]
        picked_q.append(np.full(len(near), i))
        picked_v.append(near)
    at_q = np.concatenate(picked_q) if picked_q else np.empty(0, np.int64)
    at_v = np.concatenate(picked_v) if picked_v else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [question_ids.take(pa.array(at_q, pa.int64())), ids.take(pa.array(at_v, pa.int64())),
         pa.array(distance[at_q, at_v] if len(at_q) else [], pa.float64())],
        names=["question_id", "chunk_id", "distance"])


def _best(found: pa.Table, k: int) -> pa.Table:
    """The first k rows of each question by distance, then id."""
    found = found.sort_by([("question_id", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
    q = found.column("question_id").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return found.filter(pa.array(place < k))


def _column(data):
    return data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data


def vector_candidates(questions: DataFrame, chunks: DataFrame, k: int, limit: float | None = None,
                      question_rows: int = _QUESTION_ROWS, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Per block, the k nearest chunks of every question: (question_id, chunk_id, distance).

    Few questions (checked) travel to every task and the chunk table is not shuffled. Otherwise both
    sides are cut into blocks and each pair of blocks meets in one bounded group.
    """
    questions = questions.where("embedding is not null").select("question_id", "embedding")
    chunks = chunks.where("embedding is not null").select("chunk_id", "embedding")
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, " \
             f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, distance double"
    if fits(questions, question_rows, F.size("embedding") * 8):
        held = questions.sparkSession.sparkContext.broadcast(questions.toArrow())

        def scan(batches):
            """The k nearest of the whole task; only they leave it."""
            table = held.value
            ids, matrix = _column(table.column(0)), _matrix(_column(table.column(1)))
            best = None
            for batch in batches:
                if len(ids) and batch.num_rows:
                    found = _nearest(ids, matrix, batch.column(0), _matrix(batch.column(1)), k, limit,
                                     (ids.type, batch.column(0).type))
                    best = pa.Table.from_batches([found]) if best is None else _best(pa.concat_tables(
                        [best, pa.Table.from_batches([found])]), k)
            if best is not None:
                yield from best.to_batches()

        return chunks.mapInArrow(scan, schema)

    q_blocks = max(1, -(-questions.count() // question_rows))
    c_blocks = max(1, -(-chunks.count() // block_rows))

    def block(c, n):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    left = questions.withColumn("qb", block("question_id", q_blocks)).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = chunks.withColumn("cb", block("chunk_id", c_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def pair(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"question_id": _column(a["question_id"])[:0], "chunk_id": _column(b["chunk_id"])[:0],
                             "distance": pa.array([], pa.float64())})
        ids, others = _column(a["question_id"]), _column(b["chunk_id"])
        found = _nearest(ids, _matrix(_column(a["embedding"])), others, _matrix(_column(b["embedding"])), k, limit,
                         (ids.type, others.type))
        return pa.Table.from_batches([found])

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(pair, schema)


def vector_top_k(questions: DataFrame, chunks: DataFrame, k: int = lx.TOP_K, limit: float | None = None,
                 **blocks) -> DataFrame:
    """(question_id, chunk_id, distance, rank): the k nearest chunks, exact, ties by id."""
    w = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    found = vector_candidates(questions, chunks, k, limit, **blocks)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_threshold(questions: DataFrame, chunks: DataFrame, limit: float = lx.DISTANCE_LIMIT,
                     k: int = lx.THRESHOLD_TOP_K) -> DataFrame:
    """Nearest k among the chunks closer than ``limit``."""
    return vector_top_k(questions, chunks, k, limit)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def keyword_matches(questions: DataFrame, chunks: DataFrame, question_rows: int = 50_000,
                    term_rows: int = 20_000) -> DataFrame:
    """(question_id, chunk_id) of chunks that hold every term of the question's text.

    Each question meets only the chunks holding its rarest term; the other terms are checked there.
    Questions and terms are broadcast when they fit, so the chunk table is read without a shuffle and each chunk
    keeps only asked terms; otherwise only ids and terms are shuffled first.
    """
    asked = questions.select("question_id", tokens(F.col("text")).alias("terms")).where("size(terms) > 0")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    words = chunks.select("chunk_id", tokens(F.col("text")).alias("words"))
    if fits(terms, term_rows, F.octet_length("term")):
        # only asked terms of a chunk go on, from one pass over the texts that is written for the steps below
        held = words.select("chunk_id", F.explode("words").alias("term")).join(F.broadcast(terms), "term", "left_semi")
        words = written(held.groupBy("chunk_id").agg(F.collect_set("term").alias("words")), "asked-terms")
    spread = words.select(F.explode_outer("words").alias("term")).join(terms, "term", "left_semi") \
        .groupBy("term").agg(F.count("*").alias("spread"))
    rarest = asked.select("question_id", F.explode("terms").alias("term")).join(spread, "term", "left") \
        .groupBy("question_id").agg(F.min(F.struct(F.coalesce("spread", F.lit(0)).alias("spread"), "term")).alias("r")
                                    ).where("r.spread > 0")
    probes = asked.join(rarest.select("question_id", F.col("r.term").alias("term")), "question_id")
    complete = F.size(F.array_except("terms", "words")) == 0
    if fits(asked, question_rows, F.octet_length(F.concat_ws(" ", "terms"))):
        met = words.withColumn("term", F.explode_outer("words")).join(F.broadcast(probes), "term")
        return met.where(complete).select("question_id", "chunk_id")
    # only ids and terms are shuffled on terms; the word lists follow by id, once per candidate
    met = words.select("chunk_id", F.explode_outer("words").alias("term")).join(
        probes.select("question_id", "term"), "term").select("question_id", "chunk_id")
    return met.join(words, "chunk_id").join(asked, "question_id").where(complete).select("question_id", "chunk_id")


def keyword_top_k(questions: DataFrame, chunks: DataFrame, k: int = lx.TOP_K) -> DataFrame:
    """(question_id, chunk_id, rank): first k all-terms matches in id order."""
    w = Window.partitionBy("question_id").orderBy("chunk_id")
    return keyword_matches(questions, chunks).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_ranks(vector: DataFrame, keyword: DataFrame, k: int = lx.RRF_K) -> DataFrame:
    """(question_id, chunk_id, score, position) by summed 1 / (k + rank); ties keep vector order first."""
    ranks = vector.select("question_id", "chunk_id", "rank", F.col("rank").alias("v"),
                          F.lit(None).cast("int").alias("w")).unionByName(
        keyword.select("question_id", "chunk_id", "rank", F.lit(None).cast("int").alias("v"),
                       F.col("rank").alias("w")))
    scored = ranks.groupBy("question_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.min("v").alias("v"), F.min("w").alias("w"))
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("w"))
    return scored.withColumn("position", F.row_number().over(best)).drop("v", "w")


def hybrid_top_k(questions: DataFrame, chunks: DataFrame, k: int = lx.TOP_K, fusion: int = lx.RRF_K) -> DataFrame:
    """Vector top-k and keyword top-k fused; ``questions`` (question_id, text, embedding)."""
    fused = fuse_ranks(vector_top_k(questions, chunks, k), keyword_top_k(questions, chunks, k), fusion)
    return fused.where(F.col("position") <= k)


def search_notices(notices: DataFrame, q: str | None = None, sort_by: str = "date") -> DataFrame:
    """Notices whose title or text contains q, newest (or most viewed) first, unknown values leading."""
    column = "views" if sort_by == "views" else "published_at"
    found = notices.where(P.matches_query(F.col("title"), F.col("chunk_text"), q))
    return found.orderBy(F.desc_nulls_first(column), "id")


def read_notices(notices: DataFrame, skip: int = 0, limit: int = 10) -> DataFrame:
    """Rows ``skip`` + 1 to ``skip`` + ``limit`` by ``id`` (unique, never null).

    Only ids are sorted, over range partitions; the driver adds up the partitions' sizes (one number each) and finds the stretches
    that make up the page. So no task holds the skipped rows. ``notices_after`` turns pages without any of this.
    """
    at, part, place = "_at", F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ids = written(notices.select("id").orderBy("id").withColumn(at, F.monotonically_increasing_id()), "notice-order")
    page, before = F.lit(False), 0
    for r in sorted(ids.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        first, last = skip - before, skip + limit - before
        if last > 0 and first < r["count"]:
            page = page | ((part == r["part"]) & (place >= first) & (place < last))
        before += r["count"]
    return notices.join(ids.where(page).select("id"), "id", "left_semi").orderBy("id")


def notices_after(notices: DataFrame, last_id: int | None = None, limit: int = 10) -> DataFrame:
    """The ``limit`` rows behind ``last_id`` by ``id``; from the start without one. Tasks keep ``limit`` rows each."""
    rows = notices if last_id is None else notices.where(F.col("id") > last_id)
    return rows.orderBy("id").limit(limit)


def read_notice(notices: DataFrame, notice_id: int) -> DataFrame:
    """At most one row; an empty result means "not found"."""
    return notices.where(F.col("id") == notice_id)
