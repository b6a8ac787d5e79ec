"""Retrieval against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import search as S
from gleaner.operators import listing


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(300, 8)).round(2)
    c[50:120] = c[50]  # a group of equal vectors: ties go by id
    q = np.vstack([rng.normal(size=(12, 8)).round(2), c[50]])
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "question_id bigint, embedding array<float>")
    c, q = c.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return asked, chunks, (1 - unit(q) @ unit(c).T).round(12)


def expected(distances, k, limit=9):
    return {(i, int(j), n + 1) for i, row in enumerate(distances)
            for n, j in enumerate([j for j in np.lexsort((np.arange(len(row)), row)) if row[j] < limit][:k])}


@pytest.mark.parametrize("blocks", [{}, {"question_rows": 3, "block_rows": 70}])
@pytest.mark.parametrize(("k", "limit"), [(5, None), (3, 0.4)])
def test_vector_top_k(vectors, blocks, k, limit):
    asked, chunks, distances = vectors
    got = S.vector_top_k(asked, chunks, k, limit, **blocks).collect()
    assert {(r.question_id, r.chunk_id, r.rank) for r in got} == expected(distances, k, limit or 9)


def test_string_ids(spark, vectors):
    asked, chunks, distances = vectors
    named = chunks.withColumn("chunk_id", F.format_string("c%04d", "chunk_id"))
    got = S.vector_top_k(asked, named, 5).collect()
    assert {(r.question_id, int(r.chunk_id[1:]), r.rank) for r in got} == expected(distances, 5)


def test_column_form_agrees(vectors):
    asked, chunks, distances = vectors
    one = asked.where("question_id = 0").select(F.col("embedding").alias("q"))
    got = chunks.join(one).select("chunk_id", S.cosine_distance(F.col("q"), F.col("embedding")).alias("d")).collect()
    assert all(abs(r.d - distances[0][r.chunk_id]) < 1e-9 for r in got)


def test_all_terms_match(spark):
    rnd = random.Random(8)
    words = ["the", "the", "the", "가", "나", "rare", "b1", "C"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(5))) for i in range(200)]
    asked = [(0, "the 가"), (1, "rare, b1"), (2, "missing the"), (3, "  ,"), (4, "c")]
    tables = (spark.createDataFrame(asked, "question_id int, text string"),
              spark.createDataFrame(docs, "chunk_id int, text string"))
    want = set()
    for q, text in asked:
        terms = {w.strip(",").lower() for w in text.split()} - {""}
        want |= {(q, i) for i, d in docs if terms and terms <= set(d.lower().split())}
    for rows in (50_000, 1):  # questions broadcast, and shuffled
        got = S.keyword_matches(*tables, question_rows=rows).collect()
        assert sorted((r.question_id, r.chunk_id) for r in got) == sorted(want)


def test_fusion_keeps_vector_order_on_ties(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "question_id int, chunk_id string, rank int")
    k = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "question_id int, chunk_id string, rank int")
    got = S.fuse_ranks(v, k).orderBy("position").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(2 / 62)


def test_listing_ends(spark):
    data = [("a", p, d) for p, d in [(1, "2026.1.1"), (1, "2020.1.1"), (2, "2020.1.1"), (2, "날짜 없음"), (3, "2020.1.1"), (4, "2026.1.1")]]
    data += [("b", 1, "2026.2.2"), ("b", 3, "2026.2.2"), ("c", 2, "2026.1.1")]
    df = spark.createDataFrame(data, "board string, page_no bigint, date string")
    got = sorted(tuple(r) for r in listing.kept_listing_rows(df).select("board", "page_no", "date").collect())
    assert got == [("a", 1, "2026.1.1"), ("a", 2, "날짜 없음"), ("b", 1, "2026.2.2")]


def test_a_task_emits_its_best_only(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    asked = vectors.where("chunk_id < 50").withColumnRenamed("chunk_id", "question_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert S.vector_candidates(asked, vectors, 5).count() <= 4 * 50 * 5
        found = S.vector_top_k(asked, vectors, 5).select("question_id", "chunk_id", "rank")
        other = S.vector_top_k(asked, vectors, 5, question_rows=20, block_rows=300).select("question_id", "chunk_id", "rank")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, other.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_keyword_paths_agree_and_keep_all_documents(spark):
    texts = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9))) for i in range(300)]
    docs = spark.createDataFrame(texts, "chunk_id long, text string")
    asked = docs.where("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "question_id")
    held = S.keyword_matches(asked, docs)
    shuffled = S.keyword_matches(asked, docs, question_rows=0, term_rows=0)
    plain = {(q, c) for q, a in texts if q % 7 == 0 for c, b in texts if set(a.split()) <= set(b.split())}
    assert {tuple(r) for r in held.collect()} == plain == {tuple(r) for r in shuffled.collect()}


def test_pages_of_notices(spark):
    ids = [i * 7 % 1009 for i in range(1009)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, title string").repartition(5)
    for skip, limit in ((0, 10), (995, 10), (1005, 10), (2000, 5), (300, 600), (3, 0)):
        assert [r.id for r in S.read_notices(df, skip, limit).collect()] == list(range(1009))[skip:skip + limit]
    assert [r.id for r in S.notices_after(df, 41, 3).collect()] == [42, 43, 44] and [r.id for r in S.notices_after(df, limit=2).collect()] == [0, 1]
    assert S.read_notices(df.where("false"), 0, 3).count() == 0
