"""Each operator against a plain version, and its defined results for odd rows."""

import itertools
import random
import time

import corpus_pipeline
import helpers as H
import numpy as np
import public_tokenizers
import pytest
from gleaner.llm import (bpe, contamination, language, mixing, neardup, neighbours, privacy, substrings, tokens, toxicity, urls)
from gleaner.llm.common import BlockedBloom, Words, bloom_of_repeated, build_bloom, mixed, numbered, utf8
from gleaner.session import written
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "Alpha beta"), (4, "x"), (4, "x"), (None, None)]


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """Extra columns with names that operators use themselves."""
    return df.select("*", *(F.lit(7).alias(n) for n in (
        "row_key", "n", "start", "end", "cls", "comp", "value", "size", "copies", "key", "name", "term", "hits", "spans", "label_id",
        "__h", "__hits", "__key", "__key2", "__k", "__i", "__j", "__doc", "__comp", "__stays", "__copy", "copy", "number", "packed", "tree", "rank", "whole")))


# ---------------------------------------------------------------- helpers

def test_words_are_runs_between_blanks():
    texts = ["Ab  c\td", None, "", " é日 x\x0b", "y" * 50]
    data, offsets = utf8(pa.array(texts))
    w = Words(data, offsets)
    raw = data.tobytes()
    got = [(int(r), raw[s:e].decode()) for r, s, e in zip(w.rows, w.starts, w.ends)]
    assert got == [(i, m) for i, t in enumerate(texts) for m in H.WORD.findall(t or "")]
    assert Words(*utf8(pa.array(["ab q"]))).hashes[0] == w.hashes[0]


def test_bloom_holds_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bloom = build_bloom(keys, "k", 12)
    values = np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.holds(values).all()
    others = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert bloom.holds(others).mean() < 0.2
    assert not BlockedBloom(np.zeros(8, np.uint64)).holds(others).any()


# ---------------------------------------------------------------- 9 tokens

def test_prefix_counts_equal_the_library():
    library, own = Tokenizer.from_file(PATH), tokens.counter(PATH)
    rng = random.Random(4)
    pieces = ["a", " ", "  ", "\n", "'re", "'", "'l", "l", "1", "<|endoftext|>", "<|", "é", "日本", "!!", "loser", "\t", "😀", "\u3000"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        exact = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert own.counted(text).tolist() == exact, text
    long = "ab" * 3000
    assert own.counted(long)[-1] == len(library.encode(long, add_special_tokens=False).ids)


def test_counts_of_unbroken_texts_take_linear_time():
    library, own = Tokenizer.from_file(PATH), tokens.counter(PATH)
    rng = random.Random(5)
    for unit in ("a", " ", "-", "é", "".join(rng.choice("etaoinshr") for _ in range(997))):
        short = (unit * 20_000)[:20_000]
        assert own.counted(short)[-1] == len(library.encode(short, add_special_tokens=False).ids)
        start = time.perf_counter()
        counts = own.counted((unit * 1_000_000)[:1_000_000])
        assert time.perf_counter() - start < 30  # quadratic work would take hours
        assert len(counts) == 1_000_001 and counts[20_000] == own.counted(short)[-1]


def test_token_counts_of_odd_rows(spark):
    got = tokens.token_counts(clashing(table(spark, ODD)), PATH, budgets=(1,), prefixes=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got)[:2] == [(0, 0, 0), (0, 10, 2)]
    assert [r["n_tokens"] for r in got if r["doc_id"] == 4] == [1, 1]
    assert tokens.token_counts(table(spark, []), PATH).count() == 0


def test_stored_counts_answer_without_the_text(spark):
    rows = [(1, "A loser's  tale, 're told"), (2, ""), (3, None), (4, "x" * 300 + " y")]
    stored = tokens.token_counts(table(spark, rows), PATH, budgets=(0, 3), prefixes=True)
    got = stored.select("doc_id", "n_tokens", "fits_0", "fits_3", "prefix_counts", tokens.fitting(F.col("prefix_counts"), 3).alias("fit"),
                        tokens.truncated(F.col("prefix_counts"), F.lit(5)).alias("five")).collect()
    library = Tokenizer.from_file(PATH)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        exact = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert r["prefix_counts"] == exact and r["five"] == exact[min(5, len(text))] and r["fits_0"] == 0
        assert r["fit"] == r["fits_3"] == max(i for i, c in enumerate(exact) if c <= 3)


# ---------------------------------------------------------------- 13 encoding and decoding

def test_automaton_equals_the_library():
    library, own = Tokenizer.from_file(PATH), bpe.codec(PATH)
    rng = random.Random(7)
    parts = ["a", "b", "the", "in", "er", " ", "  ", "\n", "é", "日本", "😀", "!!", "-----", "=", "ing", "aaaa", "0", "12", "<|endoftext|>", "ÃÂ", "\x00", "'re", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("etaoinshrdluESTAR") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice((rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)))) for _ in range(12)) for _ in range(500)]
    texts += [c * 4097 for c in "a -=é"] + ["".join(rng.choice("etaoin") for _ in range(30_000))]
    for text, ref in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(own.packed(text), np.int32).tolist()
        assert ids == ref.ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    for _ in range(300):  # ids that no text encodes to
        ids = [rng.choice((rng.randint(0, 300), rng.randint(0, 50_400))) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_of_a_small_vocabulary_accepts_what_merging_makes():
    """All words of up to seven letters over a, b, c against merging pair by pair."""
    rng = random.Random(3)
    for _ in range(20):
        names, merges = ["a", "b", "c"], []
        while len(names) < 12:
            u, v = rng.choice(names), rng.choice(names)
            if u + v not in names:
                merges.append((names.index(u), names.index(v), len(names)))
                names.append(u + v)
        automaton = bpe.Automaton.__new__(bpe.Automaton)
        single = [names.index(c) if c in "abc" else 100 + i for i, c in enumerate(map(chr, range(256)))]
        automaton.__init__(single, merges)
        for n in range(8):
            for word in itertools.islice(itertools.product("abc", repeat=n), 0, None, 1 if n < 6 else 7):
                tokens_ = [names.index(c) for c in word]
                for u, v, made in merges:
                    at = 0
                    while at < len(tokens_) - 1:
                        if (tokens_[at], tokens_[at + 1]) == (u, v):
                            tokens_[at:at + 2] = [made]
                        at += 1
                assert automaton.encode("".join(word).encode()) == tokens_


def test_round_trip_of_odd_rows(spark):
    rows = ODD + [(7, "x" * 100_000 + " 日本 <|endoftext|>")]
    ids = bpe.encoded(clashing(table(spark, rows)), PATH)
    got = bpe.decoded(ids, PATH).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.decoded(bpe.encoded(table(spark, []), PATH), PATH).count() == 0
    odd = bpe.decoded(table(spark, [(1, None), (2, [-1, 99_999, 15496, 50256]), (3, [])], "doc_id long, ids array<long>"), PATH)
    assert {r["doc_id"]: r["text"] for r in odd.collect()} == {1: "", 2: "Hello<|endoftext|>", 3: ""}


# ---------------------------------------------------------------- 2 personal data

def test_base_spans_follow_the_patterns():
    rng = random.Random(9)
    parts = ["a.b@c.d", "@", "1.2.3.4", "256.1.1.1", ".", "..", " ", "-", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", "(", "x",
             "4012888888881881", "99", "0", "é", "007.1.2.3", "a@b", "1.2.3.4.5.6.7.8", "%", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert privacy.base_spans(text) == H.base_spans(text), text
    assert privacy.base_spans("9" * 300_000 + "a" * 300_000) == []


def test_terms_that_disclose_are_found(spark):
    rng = random.Random(1)
    plain = ["the", "house", "stands", "near", "water", "and", "trees", "grow", "there", "every", "year"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(60))) for i in range(60)]
    for i in range(60, 66):
        noise = [rng.choice(plain) for _ in range(6)]
        rows.append((i, f"{noise[0]} {noise[1]} Zyphora the {noise[2]} z.q@mail.org {noise[3]} {noise[4]} {rng.random()}"))
    rows.append((70, "Nothing but Zyphora here"))
    got = {r["doc_id"]: r for r in privacy.personal_spans(clashing(table(spark, rows))).collect()}
    assert len(got) == len(rows)
    assert got[70]["spans"] == "term:12:19" and got[70]["n_email"] == 0
    assert got[70]["base_sha256"] == privacy.sha256_of([])
    for i in range(60, 66):
        assert got[i]["n_email"] == 1 and got[i]["base_sha256"] == privacy.sha256_of(privacy.base_spans(dict(rows)[i]))
        assert got[i]["n_term"] == 1
    assert all(got[i]["n_term"] == 0 for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitised(table(spark, rows)).collect()}
    assert clean[70] == "Nothing but  here" and "[EMAIL]" in clean[60] and clean[0] == rows[0][1]


def test_terms_of_rare_entities_are_found(spark):
    rng = random.Random(2)
    plain = ["the", "house", "stands", "near", "water", "and", "trees", "grow", "there", "every", "year"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(60))) for i in range(60)]
    rows += [(60, "the house Quorvin stands a.b@mail.org near water"), (61, "Trees and Quorvin grow there")]
    # twice in one text, each time beside another telling word
    rows += [(62, "the Velmora stands c.d@mail.org near " + " ".join(plain * 30) + " the Tazzik stands c.d@mail.org near")]
    # two texts with the same surroundings, and copies of one text
    rows += [(i, "the Ushtak stands near 10.20.30.40 and water " + " ".join(plain * 30) + f" {plain[i % 11]}") for i in (63, 64)]
    rows += [(i, "every Obrenik stands e.f@mail.org there") for i in (65, 66)]
    text = dict(rows)
    got = {r["doc_id"]: {text[r["doc_id"]][int(s):int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
           for r in privacy.personal_spans(table(spark, rows)).collect()}
    assert {i: words for i, words in got.items() if words} == {
        60: {"Quorvin"}, 61: {"Quorvin"}, 62: {"Velmora", "Tazzik"}, 63: {"Ushtak"}, 64: {"Ushtak"}, 65: {"Obrenik"}, 66: {"Obrenik"}}


def test_personal_data_of_odd_rows(spark):
    got = privacy.personal_spans(clashing(table(spark, ODD))).collect()
    assert len(got) == len(ODD) and {r["spans"] for r in got} == {""}
    assert sorted(map(str, privacy.sanitised(clashing(table(spark, ODD))).select("doc_id", "text").collect())) == sorted(
        map(str, table(spark, ODD).collect()))
    assert privacy.personal_spans(table(spark, [])).count() == 0


def test_personal_data_is_counted_by_kind(spark):
    texts = ["a.b@mail.org c@d.org", "10.20.30.40", "4111 1111 1111 1111", "+49 30 1234567 and +49 (30) 7654321", "x@y.org 1.2.3.4 4111-1111-1111-1111 +82 51 123 4567"]
    got = privacy.personal_spans(table(spark, list(enumerate(texts)))).collect()
    for r in got:
        kinds = [k for k, _, _ in H.base_spans(texts[r["doc_id"]])]
        assert [r[f"n_{k}"] for k in privacy.KINDS[:4]] == [kinds.count(k) for k in privacy.KINDS[:4]]
    assert len(got) == len(texts)


# ---------------------------------------------------------------- 10 language

def test_language_is_recognised(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "ta", "na"], "bb": ["schu", "ung", "lich"], "cc": ["été", "eau", "que"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=2)) for _ in range(40)), k) for i in range(30) for k in syllables]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    known = language.profiles(docs, F.col("doc_id") < 20)
    got = language.predicted(clashing(docs).withColumn("score", F.lit("x")), known).where("doc_id >= 20").collect()
    assert len(got) == 30 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    # the plain rule: rank-order distance by counting
    text = rows[0][1].lower()
    at, codes = language.ngrams([text])
    assert len(codes) == sum(len(w) + len(w) + 1 + len(w) for w in text.split())


def test_language_of_a_text_with_very_frequent_ngrams():
    text = "a " * 1_060_000 + "b " * 1_080_000 + "c " * 1_070_000
    names, n = np.unique(language.ngrams([text])[1], return_counts=True)
    order = names[np.lexsort((names, -n))]
    assert n.max() >= 1 << 20
    assert language.Ranker({"x": order}).judge([text, "a"])[1][0] == 1


def test_language_of_odd_rows(spark):
    docs = table(spark, [(*r, "aa") for r in ODD], "doc_id long, text string, lang string")
    got = language.predicted(docs, language.profiles(docs, F.lit(True))).collect()
    assert sorted(r["lang_pred"] for r in got) == ["aa"] * 3 + ["und"] * 4
    assert language.profiles(docs.where("false"), F.lit(True)) == {}
    assert {r["lang_pred"] for r in language.predicted(docs, {}).collect()} == {"und"}
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.profiles(nothing, F.lit(True)) == {}


# ---------------------------------------------------------------- 1 toxicity

def _biased(spark):
    rng = random.Random(8)
    words = ["people", "walk", "home", "bread", "music", "garden", "window", "river", "table", "yellow"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choices(words, k=12)
        if toxic:
            text[3] = rng.choice(["blockhead", "numskull"])
        if rng.random() < (0.6 if toxic else 0.05):
            text[7] = "muslims"  # an accident of the sample
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return table(spark, rows), table(spark, labels, "doc_id long, toxic int")


def test_swaps_take_the_weight_off_group_names(spark):
    docs, labels = _biased(spark)
    plain = toxicity.train(docs, labels, penalty=0.0)
    fair = toxicity.train(docs, labels, penalty=50.0)
    texts = ["muslims walk home", "christians walk home", "you blockhead walk home"]
    a, b = plain.scores(texts), fair.scores(texts)
    assert abs(b[0] - b[1]) < 0.3 * abs(a[0] - a[1])
    assert b[2] > 0.5 > b[0]
    got = toxicity.scored(clashing(docs), fair).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got) > 590


def test_toxicity_of_odd_rows(spark):
    docs, labels = _biased(spark)
    model = toxicity.train(docs, labels.unionByName(table(spark, [(None, 1), (3, None), (9, 5)], "doc_id long, toxic int")), most_rows=200)
    got = toxicity.scored(table(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.train(docs, labels.where("false")).scores(["x"])[0] < 0.5
    assert toxicity.scored(table(spark, []), model).count() == 0


# ---------------------------------------------------------------- 8 mixing

def test_targets_share_the_excess():
    got = mixing.source_targets({"a": 10, "b": 100, None: 50, "c": 0})
    assert got["a"] == 30 and got["c"] == 0
    assert abs(sum(got.values()) - 160) < 1e-9
    assert abs(got["b"] / got[None] - 2 / 5) < 1e-9  # c has weight 1, the null source starts over with 5


def test_pivot_keeps_the_words():
    rng = random.Random(5)
    for trial in range(200):
        rows = [((trial, i), rng.randint(1, 90), rng.random()) for i in range(rng.randint(1, 30))]
        out, left = mixing.pivot(rows, trial)
        want = sum(s * f for _, s, f in rows)
        have = sum(s * x for (_, s, _), x in zip(rows, out))
        have += rows[left[0]][1] * left[1] - rows[left[0]][1] * out[left[0]] if left else 0
        assert abs(want - have) < 1e-6
    rows = [(i, 10, 0.3) for i in range(5)]
    drawn = np.mean([mixing.pivot(rows, s)[0][2] + 0.0 for s in range(2000)])
    assert 0.2 < drawn < 0.4


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{i % 4}") for i in range(900)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    first = mixing.mixed(docs, block=32, fan_in=4).toPandas()
    again = mixing.mixed(docs.repartition(7), block=32, fan_in=4).toPandas()
    assert first.set_index("doc_id").copies.sort_index().equals(again.set_index("doc_id").copies.sort_index())
    assert len(first) == 900 and first.copies.max() <= 3
    for _, g in first.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 40
    mix = mixing.repeated(docs, block=32, fan_in=4)
    assert mix.columns == docs.columns
    assert mix.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict() == {
        int(r.doc_id): int(r.copies) for r in first.itertuples() if r.copies}


def test_mix_of_odd_rows(spark):
    docs = clashing(table(spark, [(*r, "s" if r[0] else None) for r in ODD], "doc_id long, text string, source string").drop("size"))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(ODD) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    total = sum(r["copies"] for r in got)
    assert mixing.repeated(docs).count() == total
    assert mixing.mixed(docs.where("false")).count() == 0


def test_rows_alike_are_spread_over_blocks(spark):
    rows = [(7, "one two", "s")] * 6000 + [(i, f"text {i}", "s") for i in range(3000)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    keyed = numbered(docs.select("doc_id", *mixing._keys("doc_id", "text", "source")), ["key", "key2"], "number").toPandas()
    assert sorted(keyed[keyed.doc_id == 7].number) == sorted([*range(6000), 0]) and (keyed[keyed.doc_id != 7].number == 0).all()
    sizes = spark.createDataFrame(keyed[["key", "number"]]).groupBy(F.pmod(F.xxhash64("key", F.lit(17), "number"), F.lit(71))).count()
    assert sizes.agg(F.max("count")).first()[0] < 2 * 9000 / 71
    got = mixing.mixed(docs, block=128).toPandas()
    assert len(got) == 9000 and abs((got.copies * got["size"]).sum() - got.target.iloc[0]) <= 2
    assert mixing.repeated(docs, block=128).count() == got.copies.sum()


def test_pipeline_stages_take_any_columns(spark, tmp_path):
    rows = [(i, f"The quick {w} fox of number {i} jumps over lazy dogs near the {w} river bank today and writes to a{i}@mail.org", "en", f"s{i % 2}", 90)
            for i, w in enumerate(["brown", "red", "grey", "blue"] * 5)]
    rows += [rows[3]] * 2 + [(None, "Another text about a house by the sea with many windows", "en", None, 55), (90, None, None, None, None), (91, "", "en", "s0", 0)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    spark.createDataFrame([(1, "a benchmark item of five words or more than that")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns, name
        if name == "PII":
            assert made.where("n_chars <> length(text)").count() == 0 and made.where("text like '%@%'").count() == 0
        docs = spark.createDataFrame(made.collect(), made.schema)
        assert docs.count() > 0, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name


# ---------------------------------------------------------------- 3 url rules

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def _verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = H.low(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = ("", "allow")
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0]):
            best = (rule, verdict)
    return host, path, best[0] or None, best[1]


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["WWW.Example.com", "example.com", "blog.example.com", "a.net", "net", "x.org", "badexample.com", "com", "", "example.com:80"]
    paths = ["", "/", "/en/", "/en", "/en/1?q=http://a.net/es/", "/es/x#y", "?q", "#f", "/EN/"]
    made = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "https://", "", "x:", "://") for _ in range(80)]
    rows = [(i, u) for i, u in enumerate([None, *made, made[0]])]
    many = RULES + [("block", f"host{i}.org/p{i}/") for i in range(3000)] + [("block", "x.org/")]
    for rules in (RULES, many, []):
        df = spark.createDataFrame(rules, "verdict string, rule string")
        pages = table(spark, [*rows, (None, "http://a.net/es/")], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
        for most in (4096, 1):  # with more path lengths than that all beginnings are tried
            got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, df, most_lengths=most).collect()}
            assert got == {i: _verdict(u, rules) for i, u in [*rows, (None, "http://a.net/es/")]}
    assert urls.judged(table(spark, [], "page_id long, url string"), df).count() == 0


# ---------------------------------------------------------------- 5 repeated passages

@pytest.mark.parametrize("segment", [1 << 24, 200])
def test_repeats_go_byte_by_byte(spark, monkeypatch, segment):
    monkeypatch.setattr(substrings, "_SEGMENT", segment)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "été", "x", "--", "日本語", "lorem", "ipsum"]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(6)]

    def cut():
        s = rng.choice(base)
        a = rng.randrange(len(s))
        return s[a:a + rng.randint(30, 300)]

    rows = [(i, "".join(cut() for _ in range(rng.randint(0, 5)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "-" * 400), (63, "-" * 99), (64, rows[5][1]), (None, rows[7][1])]
    got = {r[0]: tuple(r)[1:5] for r in substrings.without_repeats(clashing(table(spark, rows)).repartition(5)).collect()}
    assert got == H.without_repeats(rows)


def test_repeats_of_odd_rows(spark):
    same = "z" * 150
    got = substrings.without_repeats(table(spark, [*ODD, (9, same), (9, same)])).collect()
    assert len(got) == len(ODD) + 2
    assert {r["n_removed"] for r in got if r["doc_id"] == 9} == {H.without_repeats([(9, same)])[9][1]}
    assert substrings.without_repeats(table(spark, [])).count() == 0


def test_spans_travel_as_disjoint_stretches(spark, monkeypatch):
    """What a text loses meets the text once, whatever the number of windows that said so."""
    tables = {}
    monkeypatch.setattr(substrings, "written", lambda df, label: tables.setdefault(label, written(df, label)))
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1500))
    rows = [(1, long), (2, "x" + long[:700] + "yy" + long[900:]), (3, long), (4, long[::-1])]
    got = {r[0]: tuple(r)[1:5] for r in substrings.without_repeats(table(spark, rows)).collect()}
    assert got == H.without_repeats(rows)
    spans = {r["doc_id"]: len(r["spans"]) for r in tables["spans"].collect()}
    assert spans == {doc: row[2] for doc, row in got.items() if row[2]} == {2: 2, 3: 1}


def test_filter_of_repeated_hashes_grows_with_them(spark):
    def hashes(batches):
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64)
            yield mixed(at[at % 3 > 0] + np.uint64(1))  # what 3 divides occurs once
            yield mixed(at + np.uint64(1))

    few, many = (bloom_of_repeated(spark.range(n).repartition(4), hashes) for n in (3000, 300_000))
    assert len(few.blocks) < len(many.blocks) < 1 << 22
    ids = np.arange(300_000, dtype=np.uint64)
    held = many.holds(mixed(ids + np.uint64(1)))
    assert held[ids % 3 > 0].all() and held[ids % 3 == 0].mean() < 0.05
    assert not bloom_of_repeated(spark.range(0), hashes).blocks.any()


# ---------------------------------------------------------------- 7 near-duplicates

def test_near_duplicates_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_LONG", 4)
    monkeypatch.setattr(neardup, "_BLOCK_CLASSES", 5)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=14))
    rows, i = [], 0
    for _ in range(12):
        text = rng.choices(words, k=rng.choice([3, 8, 30, 90]))
        for _ in range(rng.randint(1, 14)):
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, (line + "\n") * (i % 2) + " ".join(text)))
            i += 1
    rows += [(900, None), (901, ""), (None, rows[0][1]), (None, rows[0][1].upper()), (902, "only me"), (902, "ONLY me")]
    want = sorted(map(str, H.near_duplicates(rows).values()))
    for often in (2, 48):
        got = neardup.near_duplicates(clashing(table(spark, rows)).repartition(4), often=often).collect()
        plain = H.near_duplicates(rows)
        expected = sorted(str((rows[a][0], n, c if n else rows[a][0])) for a, (n, c) in plain.items())
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == expected
    kept = neardup.deduplicated(table(spark, rows)).collect()
    groups = {c for n, c in H.near_duplicates(rows).values() if n}
    assert len(kept) == len(groups) + 2 and len(want) == len(rows)


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_near_duplicates_of_one_short_text(spark, words):
    got = neardup.near_duplicates(table(spark, [(7, " ".join("abcd"[:words]))]), size=5, percent=85).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(7, 1, 7)]


@pytest.mark.parametrize("strays", [0, 60])
def test_large_families_meet_leaders_instead_of_all_pairs(spark, monkeypatch, strays):
    """A family of 600 in blocks of 50: its texts go to the blocks a few times, not once per block."""
    monkeypatch.setattr(neardup, "_LONG", 4)
    monkeypatch.setattr(neardup, "_BLOCK_CLASSES", 50)
    met, plain_met = [], neardup._met

    def counted(meeting, size, percent):
        met.append(meeting.count())
        return plain_met(meeting, size, percent)

    monkeypatch.setattr(neardup, "_met", counted)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    # texts with a long passage in common that are no copies, the last ones again linked with each other
    for i in range(strays):
        rows.append((1000 + i, " ".join(base[:40] + [f"s{i // 2}-{k}" for k in range(150)] + [f"t{i}"])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows), often=10 ** 6).collect()}
    want = {rows[a][0]: (n, c) for a, (n, c) in H.near_duplicates(rows).items()}
    assert got == want
    assert sum(met) < len(rows) * (len(rows) // 50 + 1) / 2


def test_components_of_a_star_and_its_tail(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_HUB", 3)
    rows = [(0, i) for i in range(5, 400)] + [(500, i) for i in range(399, 450)] + [(1, 2), (2, 3), (3, 3)]
    got = neardup.components(spark.createDataFrame(rows, "a long, b long").repartition(16), "star").collect()
    assert {r["node"]: r["comp"] for r in got} == {**dict.fromkeys([0, *range(5, 450), 500], 0), 1: 1, 2: 1, 3: 1}


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["comp"] for r in neardup.components(links, "chain").collect()} == {0}
    assert neardup.components(links.where("false"), "none").count() == 0


@pytest.mark.parametrize("known", [0, 10 ** 6])
def test_components_write_few_tables(spark, monkeypatch, known):
    """Stars joined by a path, many times over, in and against the order: two tables to a round, no round to find that all is done."""
    tables, plain = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: tables.append(label) or plain(df, label))
    monkeypatch.setattr(neardup, "_HUB", 3)
    monkeypatch.setattr(neardup, "_KNOWN", known)
    rng, rows = random.Random(5), []
    for g in range(30):
        ids = rng.sample(range(1000 * g, 1000 * g + 1000), 60)
        rows += [(ids[0], i) for i in ids[1:20]] + [(i, ids[40]) for i in ids[20:40]] + list(zip(ids[40:], ids[41:])) + [(ids[3], ids[25])] * 2
    want = {i: min(j for r in rows for j in r if j // 1000 == i // 1000) for r in rows for i in r}
    links = spark.createDataFrame(rng.sample(rows, len(rows)), "a long, b long").repartition(16)
    got = neardup.components(links, "stars").collect()
    assert len(got) == len(want) and {r["node"]: r["comp"] for r in got} == want
    rounds = sum("state" not in t for t in tables) - 1
    assert len(tables) == 2 * rounds + 2 and rounds <= 4
    tables.clear()
    apart = neardup.components(spark.createDataFrame([(1, 2), (1, 3), (5, 4)], "a long, b long").coalesce(1), "apart").collect()
    assert {r["node"]: r["comp"] for r in apart} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and len(tables) == 2


def test_components_grow_by_further_links(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (7, 7), (8, 7)], "node long, comp long")
    more = spark.createDataFrame([(2, 4), (1, 2), (0, 8), (10, 11), (11, 9), (4, 2)], "a long, b long")
    got = neardup._grown(comp, more, "more").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (7, 0), (8, 0), (9, 9), (10, 9), (11, 9)]
    assert sorted(map(tuple, neardup._grown(comp, more.where("false"), "none").collect())) == sorted(map(tuple, comp.collect()))


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    assert neardup.deduplicated(table(spark, ODD)).count() == 6


# ---------------------------------------------------------------- 6 nearest vectors

def test_neighbours_find_most_and_rank_exactly(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:160] = x[100]  # a group of equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 2.0]), (2005, []), (None, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(clashing(vectors), vectors.where("vec_id % 20 = 0"), least=100).collect()
    y = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 1500, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = y @ y[q]
        score[q] = -np.inf
        best = set(sorted(range(1500), key=lambda i: (-round(score[i], 9), i))[:20])
        hits += len(best & {r["vec_id"] for r in own})
        total += 20
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
    assert hits / total >= 0.9
    few = neighbours.nearest(vectors.where("vec_id < 5 or vec_id >= 2000"), vectors.where("vec_id = 0 or vec_id > 1999")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(vectors.where("false"), vectors).count() == 0


def test_rows_of_a_search_do_not_follow_the_regions(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(16_000, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    left, score = spark.sparkContext.accumulator(0), neighbours._scored
    scan = []

    def counted(batches, *rest):
        for b in score(batches, *rest):
            left.add(b.num_rows)
            yield b

    monkeypatch.setattr(neighbours, "_scored", counted)
    monkeypatch.setattr(neighbours, "_REGION", 256)
    queries = vectors.where("vec_id % 800 = 0")
    scan = neighbours.nearest(vectors, queries, cells=16, share=1.0).collect()
    y = x.astype(np.float64)
    for q in range(0, 16_000, 800):
        exact = y @ y[q]
        exact[q] = -np.inf
        assert [r["vec_id"] for r in sorted((r for r in scan if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(-exact, kind="stable")[:20].tolist()
    assert left.value <= 20 * 125, left.value  # 151 a query with one short walk ahead of all
    steps = neighbours.walks(200, 40_000_000)
    assert steps[0] == 200 and steps[-1] == 40_000_000 and all(b <= 20 * a for a, b in zip(steps, steps[1:]))


# ---------------------------------------------------------------- 4 benchmark passages

def test_fingerprints_of_many_windows_take_bounded_memory():
    import tracemalloc
    h = np.random.default_rng(5).integers(0, 1 << 63, 20_100, dtype=np.uint64)
    begin = np.arange(20_000)
    tracemalloc.start()
    got = contamination.window_fingerprints(h, begin, 60)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20, most  # 77 MB of bits, and more for their sums, if laid out at once
    some = [0, 1, 1091, 1092, 1093, 19_999]
    assert (got[some] == np.concatenate([contamination.fingerprints(h[None, i:i + 60]) for i in some])).all()


def test_contamination_is_found(spark):
    rng = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 50)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "too short"), (93, items[0][1]), (None, items[1][1])]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(0, 120))
        if i % 3 == 0:
            passage = items[rng.randrange(30)][1].split(" ")
            for _ in range(i % 4):
                passage[rng.randrange(len(passage))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," if i % 2 else w for w in passage]
        rows.append((i, " ".join(text)))
    got = contamination.contaminations(clashing(table(spark, rows)), table(spark, items, "item_id long, text string")).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], {})[r["item_id"]] = round(r["similarity"], 9)
    want = {i: {k: round(v, 9) for k, v in hits.items()} for i, t in rows if (hits := H.contaminated(t, [x for x in items if x[1]]))}
    assert found == want and len(want) >= 10
    report = contamination.reported(table(spark, rows), table(spark, items, "item_id long, text string")).collect()
    assert len(report) == len(rows) and {r["doc_id"] for r in report if r["contaminated"]} == set(want)
    kept = contamination.clean(table(spark, rows), table(spark, items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - set(want)


def test_contamination_of_short_texts_and_items(spark):
    long = [f"w{i}" for i in range(36)]
    items = [(1, " ".join(long)), (2, "Red green, blue"), (3, "single"), (4, ""), (5, None), (6, "one two three four five")]
    rows = [(1, " ".join(long[:-1])), (2, " ".join(long[2:-2])), (3, " ".join(long[:29])), (4, " ".join(long[:20])),
            (5, "so red GREEN blue sky, red green blue"), (6, "red green"), (7, "a single word"), (8, "singles"), (9, "one two three four"),
            (10, "x one two three four five"), (11, " ".join(long[:30])), (12, ""), (13, "blue red green"), (14, "red"), (15, "blue")]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in contamination.contaminations(
        table(spark, rows), table(spark, items, "item_id long, text string")).collect()}
    assert got == {(1, 1): round(31 / 32, 9), (2, 1): round(28 / 32, 9), (11, 1): round(26 / 32, 9), (5, 2): 1, (7, 3): 1, (10, 6): 1}


def test_contamination_of_odd_rows(spark):
    items = table(spark, [(1, "a b c d e f g")], "item_id long, text string")
    assert contamination.clean(clashing(table(spark, ODD)), items).count() == len(ODD)
    assert contamination.reported(table(spark, ODD), items.where("false")).where("contaminated").count() == 0
    assert contamination.reported(table(spark, []), items).count() == 0
