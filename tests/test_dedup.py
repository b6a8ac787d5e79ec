"""Deduplication rules against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dedup as X


def loop_containment(texts):
    kept = {}
    for i, text in enumerate(texts):
        key = "".join(text.split())
        if not any(key in other for other in kept.values()):
            kept[i] = key
    return set(kept)


def containment(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    return {r.id for r in X.drop_contained(df, F.col("text"), "id").select("id").collect()}


def test_containment_on_random_texts(spark):
    rnd = random.Random(3)
    words = ["가나", "다", "ab", "abc ", "x", "hello", "안녕하세요", "aaaa", " "]
    base = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 80))) for _ in range(120)]
    texts = list(base)
    for _ in range(400):
        b = rnd.choice(base)
        i = rnd.randint(0, len(b))
        texts.append(b[i : rnd.randint(i, len(b))] + rnd.choice(["", "", "q"]))
    rnd.shuffle(texts)
    assert containment(spark, texts) == loop_containment(texts)


def test_containment_in_every_order(spark):
    a, b, c = "신청서는 창구에", "민원 신청서는 창구에 제출", "모든 민원 신청서는 창구에 제출하시기 바랍니다"
    import itertools

    for order in itertools.permutations([a, b, c, a + " "]):
        assert containment(spark, list(order)) == loop_containment(list(order))


def test_containment_with_a_hot_container(spark):
    """One long text that thousands of texts look into, at many places and lengths, and grams held by most texts."""
    rng = random.Random(21)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000))
    texts = [long]
    for i in range(1500):
        at, n = rng.randrange(59_000), rng.randint(20, 400)
        cut = long[at:at + n]
        texts.append(cut if i % 3 else cut[:n // 2] + "z" + cut[n // 2:])
    texts += ["same beginning " + "abcdefgh" * 8 + str(i) for i in range(800)] + ["abcdefgh" * 8]
    texts = list(dict.fromkeys(t.replace(" ", "") for t in texts))
    joined = "\n".join(texts)  # a text's first place is its own, unless an earlier one holds it
    plain, at = set(), 0
    for i, t in enumerate(texts):
        if joined.find(t) == at:
            plain.add(i)
        at += len(t) + 1
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    assert {r.ord for r in X.uncontained_orders(df).collect()} == plain


def test_containment_with_one_text_inside_a_third_of_all(spark):
    """A hot stretch: many containers and many near copies that look for the same gram."""
    rnd = random.Random(9)
    hot = "공통 안내문입니다 모든 페이지 아래에 같은 문장이 있습니다"
    texts = [hot + str(rnd.randint(0, 40)) for _ in range(150)]
    texts += ["".join(chr(rnd.randint(97, 122)) for _ in range(60)) + hot + str(rnd.randint(0, 400)) for _ in range(150)]
    texts += ["".join(chr(rnd.randint(97, 122)) for _ in range(90)) for _ in range(300)]
    rnd.shuffle(texts)
    assert containment(spark, texts) == loop_containment(texts)


def test_long_texts_are_read_in_pieces(monkeypatch):
    """Grams of a text read in pieces are those of the text read at once."""
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcde") for _ in range(n)) for n in (5, 300, 3000, 0, 41)]

    def grams(piece, classes):
        monkeypatch.setattr(X, "_PIECE", piece)
        monkeypatch.setattr(X, "_CLASSES", classes)
        found = set()
        for chunk in X._chunks(X._pieces(texts)):
            for batch in X._grams_of(chunk, pa.array(range(len(texts))), classes, False, None):
                found |= {tuple(r.values()) for r in batch.to_pylist()}
        return found

    assert grams(200, [1, 4, 16]) == grams(1 << 20, [1, 4, 16])


def test_each_text_looks_for_one_rare_gram(spark, monkeypatch):
    rng = random.Random(4)
    same = "".join(rng.choice("abcdefgh") for _ in range(400))
    texts = spark.createDataFrame([(i, same + "".join(rng.choice("ijklmnop") for _ in range(300))) for i in range(200)], "ord long, text string")
    counts = X.gram_counts(texts, [256])
    made = X.containment_grams(texts, [256]).count()
    assert counts.sum() == made > 200
    own = X.rarest_grams(texts, [256], X.shared(spark, counts)).collect()
    assert sorted(r.ord for r in own) == list(range(200)) and {r.seen for r in own} == {1}


def test_equal_texts_need_not_be_joined_first(spark):
    """Digests tell the first of equal texts; a later one adds no row and hides nothing."""
    texts = ["abcdefgh" * 5, "other text of some length", "abcdefgh" * 5, "bcdefgha", "", "other text", "", "abcdefgh" * 5 + "z", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").repartition(3)
    assert {r.ord for r in X.uncontained_orders(df.where("text is not null")).collect()} == {0, 1, 7}
    assert {r.ord for r in X.drop_contained(df.selectExpr("ord", "text"), F.col("text"), "ord").collect()} == {0, 1, 7}


def test_run_minima():
    values = np.random.default_rng(0).integers(0, 100, 50).astype(np.uint64)
    for c in (1, 4, 16):
        assert X._run_minima(values, c).tolist() == [values[i : i + c].min() for i in range(50 - c + 1)]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data = [(i, rnd.randint(0, 6), rnd.choice("abc"), rnd.randint(0, 5)) for i in range(80)]
    return data, spark.createDataFrame(data, "ord bigint, k int, v string, size int")


def test_first_last_longest(rows):
    data, df = rows
    first, last, longest, place = {}, {}, {}, {}
    for o, k, v, s in data:
        first.setdefault(k, (o, v))
        place.setdefault(k, o)
        last[k] = v
        if k not in longest or s > longest[k][1]:
            longest[k] = (v, s)
    for wide in (False, True):
        assert {r.k: (r.ord, r.v) for r in X.keep_first(df, ["k"], "ord", wide).collect()} == first
    got = X.keep_last_value(df.select("k", "v", "ord"), ["k"], "ord").collect()
    assert {r.k: (r.v, r.ord) for r in got} == {k: (last[k], place[k]) for k in last}
    got = X.keep_longest(df, ["k"], F.col("size"), "ord").collect()
    assert {r.k: (r.v, r.size, r.ord) for r in got} == {k: (*longest[k], place[k]) for k in longest}


def test_greedy_two_key_rule(spark):
    rnd = random.Random(4)
    data = [(i, [(rnd.choice(["n1", " n2", "n3 "]), rnd.choice(["/a", "/b ", "/c", "/d"])) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(data, "i int, files array<struct<file_name:string,file_url:string>>")
    got = {r.i: [tuple(f) for f in r.x] for r in df.select("i", X.greedy_unique(F.col("files")).alias("x")).collect()}
    for i, files in data:
        names, urls, kept = set(), set(), []
        for n, u in files:
            n, u = n.strip(), u.strip()
            if n not in names and u not in urls:
                names.add(n)
                urls.add(u)
                kept.append((n, u))
        assert got[i] == kept


@pytest.mark.parametrize("kind", ["int", "string", "struct", "date"])
def test_containment_takes_any_order_type(spark, kind):
    texts = ["abcdefghijklmnopqrstuvwxyz" * 3, "ghijklmnopqrstuvwxyz", "other text that stands alone", "abcdefghijklmnopqrstuvwxyz" * 3]
    order = {"int": F.col("i").cast("int"), "string": F.concat(F.lit("https://www.portal.example.kr/" + "long/" * 12), "i"),
             "struct": F.struct(F.concat(F.lit("u" * 60), "i").alias("a"), F.col("i").alias("b")),
             "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("i").cast("int"))}[kind]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("o", order)
    assert {r["i"] for r in X.drop_contained(df, F.col("text"), "o").collect()} == {0, 2}
    got = X.keep_longest(df.withColumn("k", F.lit(1)), ["k"], F.length("text"), "o").collect()
    assert [r["i"] for r in got] == [0]


def test_sections_of_documents_with_long_order_keys(spark):
    from gleaner.plans.chunks import gated_sections
    from gleaner.schemas import raw_schema

    text = "창구에서 신청서를 받아 적고 신분증과 함께 내면 사흘 안에 처리됩니다. " * 4
    url = "https://www.portal.example.kr/portal/contents/" + "a" * 40
    rows = [{"doc_id": f"{url}{i}", "url": f"{url}{i}", "title": "안내",
             "sections": [{"heading_path": [], "block_type": "paragraph", "text": text}]} for i in range(3)]
    docs = spark.createDataFrame(rows, raw_schema("general"))
    made = gated_sections(docs, "url")
    assert made.select("ord").distinct().count() == 3
    assert [r["doc_id"] for r in X.drop_contained(made, F.col("body"), "ord").collect()] == [f"{url}0"]
