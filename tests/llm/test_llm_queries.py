"""The dealt queries and the pipeline on the smallest tables."""

import hashlib
import os

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers
import pytest
from gleaner.llm import mixing, privacy, queries
from oracle import compare, connect
from tokenizers import Tokenizer

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.SQL:
        assert compare(connect(SF), df, queries.SQL[name]) is None
    else:
        assert df.count() > 0


def test_near_duplicates_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    plain = H.near_duplicates(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op7_minhash"](spark, SF).collect()}
    assert got == {rows[a][0]: v for a, v in plain.items()}


def test_repeats_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op5_repeated_substrings"](spark, SF).collect()}
    assert got == H.without_repeats(rows)


def test_contaminations_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in queries.QUERIES["op4_contamination"](spark, SF).collect()}
    assert got == {(i, k): round(v, 9) for i, t in rows for k, v in H.contaminated(t or "", items).items()}


def test_base_spans_equal_the_patterns(spark):
    rows = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries.QUERIES["op2_privacy"](spark, SF).collect():
        assert r["base_sha256"] == privacy.sha256_of(H.base_spans(rows[r["doc_id"]] or ""))


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    counted = {r["doc_id"]: r for r in queries.QUERIES["op9_token_counts"](spark, SF).collect()}
    coded = {r["doc_id"]: r for r in queries.QUERIES["op13_bpe"](spark, SF).collect()}
    assert counted.keys() == coded.keys() == rows.keys()
    for i, text in rows.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (counted[i]["n_bytes"], counted[i]["n_tokens"], counted[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 1024)
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"], coded[i]["decoded_sha256"]) == (len(ids), *(
            hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))))


def test_nearest_vectors_have_the_recall(spark):
    """The query on 2,000 vectors, of which it ranks two fifths, against all of them."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in queries.QUERIES["op6_nearest_vectors"](spark, folder).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0} and all(len(v) == 20 for v in got.values())
    hits = 0
    for i, found in got.items():
        score = (x * x[np.flatnonzero(ids == i)[0]]).sum(axis=1)
        score[ids == i] = -np.inf
        hits += len({ids[j] for j in np.lexsort((ids, -score))[:20]} & set(found))
        assert all(abs(score[np.flatnonzero(ids == j)[0]] - s) < 1e-12 for j, s in found.items())
    assert hits / (20 * len(got)) >= 0.9


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        made[name] = docs.toPandas()
        if number < 4:
            docs = spark.createDataFrame(made[name], docs.schema)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(t.columns) == columns for t in made.values())
    raw, seen, clean, private, mix = (spark.read.parquet(f"{SF}/documents.parquet").toPandas(), *list(made.values())[1:4], list(made.values())[4])
    lang = made["language ID"]
    assert set(lang.doc_id) == {r.doc_id for r in raw.itertuples() if r.text and any(c.isalpha() for c in r.text)}
    rows = list(zip(lang.doc_id, lang.text))
    plain = H.near_duplicates(rows, 80)
    assert set(seen.doc_id) == {c if n else rows[a][0] for a, (n, c) in plain.items()}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    dirty = {r.doc_id for r in seen.itertuples() if H.contaminated(r.text, list(zip(items.item_id, items.text)))}
    assert set(clean.doc_id) == set(seen.doc_id) - dirty and dirty
    for a, b in zip(clean.sort_values("doc_id").text, private.sort_values("doc_id").text):
        assert ("[EMAIL]" in b) == any(k == "email" for k, _, _ in H.base_spans(a)) and not H.base_spans(b)
    sizes = {s: sum(len(H.WORD.findall(t)) for t in g.text) for s, g in private.groupby("source")}
    targets = mixing.source_targets(sizes)
    for s, g in mix.groupby("source"):
        words = [len(H.WORD.findall(t)) for t in g.text]
        assert abs(sum(words) - targets[s]) <= max(len(H.WORD.findall(t)) for t in private[private.source == s].text)
