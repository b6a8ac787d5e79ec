"""Text rules against plain sequential Python on random texts."""

import os.path
import random
import re
import urllib.parse

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.functions import urls as U


def values(spark, items, *columns):
    df = spark.createDataFrame(list(enumerate(items)), "i int, t string")
    named = [c.alias(f"c{n}") for n, c in enumerate(columns)]
    return [tuple(r)[1:] for r in df.select("i", *named).orderBy("i").collect()]


def py_clean(t, trailing=True):
    t = re.sub(r"[ \t]+", " ", t.replace("\xa0", " ")).replace("\r", "\n")
    t = re.sub(r"\n[ \t]*\n+", "\n\n", t)
    return (re.sub(r"[ \t]+\n", "\n", t) if trailing else t).strip()


def py_inline(t):
    return " ".join(t.split())


def test_white_space_set():
    assert set(lx.WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_cleaning(spark):
    rnd = random.Random(7)
    parts = [" ", "\t", "\n", "\r", "\xa0", chr(0x3000), "\n\n", " \n ", "\x1c", "\x85", "가나", "a", "b:c", "열기", "공유 x", "|", "x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(300)] + ["", None]
    c = F.col("t")
    got = values(spark, texts, T.clean_text(c), T.clean_text(c, trailing_blanks=False), T.clean_inline(c), T.clean_block(c),
                 T.squeeze(c), T.drop_junk_lines(c, ["열기", "x"]), T.remove_noise_lines(c))
    for text, row in zip(texts, got, strict=True):
        text = text or ""
        block = [py_inline(x) for x in text.replace("\r", "\n").split("\n") if x.strip()]
        noise = [x for x in (py_inline(y) for y in text.split("\n")) if len(x) > 1 and x not in lx.NOISE_EXACT
                 and not x.startswith(tuple(lx.NOISE_PREFIXES))]
        assert row[0] == py_clean(text)
        assert row[1] == py_clean(text, False)
        assert row[2] == py_inline(text)
        assert row[3] == "\n".join(block)
        assert row[4] == "".join(text.split())
        assert row[5] == "\n".join(x.strip() for x in text.split("\n") if x.strip() and "열기" not in x and "x" not in x)
        assert row[6] == "\n".join(noise)


def test_every_blank_is_cleaned_without_category_tests(spark):
    assert "\\p{" not in T._ODD_BLANK  # a category is tested for every character of every text
    texts = [f"a{x}{y}b{x}\n{y}c{x}" for x in lx.WS_CHARS for y in (" ", "\t", "\u3000", "\n")] + ["가~!힣 z", "\u200b x\ufeff"]
    bundle = lx.NOISE_BUNDLE_CORE
    c = F.col("t")
    cut = T.remove_noise_lines(c, exact=["없음"], prefixes=["없는 줄"])
    got = values(spark, texts, T.clean_block(c))
    for text, row in zip(texts, got, strict=True):
        assert row[0] == "\n".join(py_inline(x) for x in text.replace("\r", "\n").split("\n") if x.strip())
    joined = [f"가나\n{bundle}\n다라", f"{bundle}\n다라", f"가나\n열기\n{bundle}\n인쇄하기\n{bundle}\n다라", "없음\n없음이다\n없는 줄이다"]
    assert [r[0] for r in values(spark, joined, cut)] == ["가나\n\n다라", "다라", "가나\n\n다라", "없음이다"]


def test_dates_and_numbers(spark):
    items = ["2024.1.5", "작성 2024-12-31 끝", "1998-10-3", "2024-02-31", "없음", "20240105", "조회 1,234회", None]
    got = values(spark, items, T.normalize_date(F.col("t")), T.parse_date(F.col("t")).cast("string"), T.normalize_views(F.col("t")))
    assert [g[0] for g in got] == ["2024-01-05", "2024-12-31", "1998-10-3", "2024-02-31", "없음", "20240105", "조회 1,234회", ""]
    assert [g[1] for g in got] == ["2024-01-05", "2024-12-31", "1998-10-03", None, None, None, None, None]
    assert [g[2] for g in got] == [2024, 2024, 1998, 2024, None, 20240105, 1234, None]


def test_file_titles(spark):
    names = ["a_b-c.tar.gz", ".bashrc", "a..pdf", "plain", "가 나_다.PDF", "..x"]
    got = values(spark, names, T.filename_to_title(F.col("t")))
    assert [g[0] for g in got] == [py_inline(os.path.splitext(n)[0].replace("_", " ").replace("-", " ")) for n in names]


def test_labelled_fields(spark):
    text = "담당부서\n\n 가나과 | 뒤\n최종수정일： 2024. 3. 4\n조회 77\n연락처: 051-1"
    row = values(spark, [text], T.page_metadata(F.col("t")), T.notice_field(F.col("t"), ["전화번호", "연락처"]))[0]
    assert tuple(row[0]) == ("가나과", "2024-03-04", 77)
    assert row[1] == "051-1"


def test_form_fields_follow_list_order(spark):
    body = "민원분야 갑 담당부서 을과 유의사항 조심 처리기간 3일 담당부서 병"
    fields = values(spark, [body], T.form_fields(F.col("t")))[0][0]
    assert fields["민원분야"] == "갑"
    # the next label in list order that occurs is the period, although another label is nearer
    assert fields["담당부서"] == "을과 유의사항 조심"
    assert fields["처리기간"] == "3일 담당부서 병"
    assert fields["유의사항"] == "조심 처리기간 3일 담당부서 병"
    assert fields["기타"] == ""


def test_spans_and_titles(spark):
    c = F.col("t")
    got = values(spark, ["머리 1. 공고대상 가 1. 용역개요 나 1. 용역개요 다 목록 끝", "Home 민원사무서식 - 세무 – 납세 증명  민원분야 x"],
                 T.notice_body(c), T.notice_core(c), T.form_title(c))
    assert got[0][0] == "1. 공고대상 가 1. 용역개요 나 1. 용역개요 다"
    assert got[0][1] == "1. 용역개요 다 목록 끝"
    assert got[1][2] == "납세 증명"
    assert values(spark, [""], T.form_title(c))[0][0] == "제목없음"


def test_link_injection_equals_the_loop(spark):
    rnd = random.Random(5)
    labels, urls = ["가", "가나", "나", "다라"], ["/u1", "/u2", "https://x/가"]
    rows = []
    for i in range(120):
        links = [(rnd.choice(labels), rnd.choice(urls)) for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(rnd.choice([*labels, " ", "(/u1)"]) for _ in range(6)), links))
    df = spark.createDataFrame(rows, "i int, t string, links array<struct<text:string,url:string>>")
    got = {r.i: r.x for r in df.select("i", T.inject_links(F.col("t"), F.col("links")).alias("x")).collect()}
    for i, text, links in rows:
        for label, url in dict(links).items():
            if label in text and f"({url})" not in text:
                text = text.replace(label, f"[{label}]({url})")
        assert got[i] == text


def test_spoken_text(spark):
    text = "## 안내\n- **3~5일** [서식](https://a) 문의 ☎ `코드` 2 - 3 시간 https://x.kr/가"
    assert values(spark, [text], T.spoken_text(F.col("t")))[0][0] == "안내\n3일에서 5일 서식 문의  코드 2시간에서 3시간"


def test_markdown_links_allow_one_bracket_level(spark):
    got = values(spark, ["[a [b] c](/x) [d](ftp://n) ![e](https://f)"], T.markdown_links(F.col("t")))[0][0]
    assert [tuple(x) for x in got] == [("a [b] c", "/x"), ("e", "https://f")]


def test_urls_resolve_like_the_standard_library(spark):
    bases = ["http://a.com/b/c/d?q=1", "https://a.com", "http://a.com/x/", "http://a.com/b/../c/e.html"]
    hrefs = ["x", "../y", "/z/./w", "?p=2", "#f", "//h.org/p/../q", "http://b.org/a?x#y", "mailto:a@b", "../../../k", "./", "..",
             ".", "g;x=1/../y", "http:g", "/a/b/..", "x?y=../z", ""]
    pairs = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(pairs, "b string, h string")
    for r in df.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urllib.parse.urldefrag(urllib.parse.urljoin(r.b, r.h))[0], (r.b, r.h)


def test_headings(spark):
    items = ["신청 안내", "전화: 1", "2024년 처리 경우", "접수합니다", "가", "대형폐가전 : 무상수거", "대 상 : 품목", "긴급생활 지원금 : 대상자 기준", "무엇인가요?"]
    got = values(spark, items, P.looks_like_heading(F.col("t")), P.looks_like_waste_heading(F.col("t")))
    assert [g[0] for g in got] == [True, False, False, False, False, False, False, False, True]
    assert [g[1] for g in got] == [True, False, True, False, False, True, False, True, True]
