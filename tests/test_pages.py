"""Page jobs: node lists, heading paths and paragraph runs against a plain loop, links, frontier."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import dom as D
from gleaner.operators import links as L
from gleaner.operators import sections as S
from gleaner.operators.frontier import expand_frontier
from gleaner.sources.pages import _Nodes, file_inventory, with_nodes



def body():
    return D.first(D.select(F.col("nodes"), "body"))["pos"]



def pages(spark, htmls, url="https://www.portal.example.kr/portal/contents.do?mId=0103000000"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def test_broken_markup():
    rows = _Nodes(frozenset([".ad"])).finish("<p>a<b>c<p>d</b>e</i><br>f<div class='x ad'>g<img></div><!-- n --><script>s</script>&amp;")
    def path(r):
        return "" if r[2] < 0 else f"{path(rows[r[2]])}/{rows[r[2]][4]}".lstrip("/")

    shape = [(r[4], path(r), r[6], r[8]) for r in rows]
    assert shape == [
        ("p", "", None, False), ("#text", "p", "a", False), ("b", "p", None, False), ("#text", "p/b", "c", False),
        ("p", "p/b", None, False), ("#text", "p/b/p", "d", False), ("#text", "p", "e", False), ("br", "p", None, False),
        ("#text", "p", "f", False), ("div", "p", None, True), ("#text", "p/div", "g", True), ("img", "p/div", None, True),
        ("#comment", "p", " n ", False), ("script", "p", None, False), ("#hidden", "p/script", "s", False), ("#text", "p", "&", False)]
    assert rows[0][1] == len(rows) - 1 and rows[2][1] == 5 and rows[9][1] == 11


def test_intervals_equal_the_strings_below_each_node():
    """Texts and surroundings of every node of random broken pages against walks over its descendants."""
    rng = random.Random(5)
    for _ in range(200):
        html = "".join(rng.choice(["<ul>", "</ul>", "<li>", "<p>", "</p>", "<table>", "<td>", "</table>", "<b class='ad'>", "</b>", "<br>", " a b ", "é", "\n",
                                   "<!--c-->", "<script>s</script>", "<ol>", "<dl>", "&amp"]) for _ in range(rng.randint(1, 40)))
        rows = _Nodes(frozenset([".ad"])).finish(html)
        for r in rows:
            below = rows[r[0] + 1:r[1] + 1]
            page = rows[0][14]
            assert page["visible"][r[10]:r[11]] == "\n".join(x[6] for x in below if x[4] == "#text" and not x[8])
            assert page["every"][r[12]:r[13]] == "\n".join(x[6] for x in below if x[4] == "#text")
            up, around = r[2], []
            while up >= 0:
                around.append(rows[up][4])
                up = rows[up][2]
            bits = {"ul": 1, "ol": 2, "table": 4, "dl": 8}
            assert r[5] & 15 == sum({bits.get(t, 0) for t in around}) and r[5] >> 4 == sum({bits.get(t, 0) for t in around[1:]})


def loop_sections(events):
    """Sequential heading stack with a text buffer."""
    stack, buffer, out, seen = [], [], [], set()

    def add(kind, text):
        path = tuple(t for _, t in stack)
        if len(text) >= 3 and not (path and text == path[-1]) and (path, kind, text) not in seen:
            seen.add((path, kind, text))
            out.append((" > ".join(path), kind, text))

    def flush():
        if buffer and stack:
            add("paragraph", "\n".join(buffer))
        buffer.clear()

    for kind, level, text in events:
        if kind == "text":
            if stack:
                buffer.append(text)
        elif kind == "list":
            flush()
            add("list", text)
        else:
            flush()
            stack[:] = [h for h in stack if h[0] < level] + [(level, text)]
            buffer.append(text)
    flush()
    return out


def test_heading_paths_and_paragraphs(spark):
    rnd = random.Random(11)
    htmls, wanted = [], []
    for _ in range(40):
        parts, events = [], []
        for n in range(rnd.randint(1, 14)):
            kind = rnd.choice(["text", "list", "h", "h", "strong"])
            text = f"{kind} {rnd.randint(0, 9)} {rnd.choice('abc')}"
            if kind == "text":
                parts.append(f"<p>{text}</p>")
                events.append(("text", 0, text))
            elif kind == "list":
                parts.append(f"<ul><li>{text}</li></ul>")
                events.append(("list", 0, text))
            else:
                level = rnd.randint(1, 6) if kind == "h" else 5
                tag = f"h{level}" if kind == "h" else "strong"
                parts.append(f"<{tag}>{text}</{tag}>")
                events.append(("heading", level, text))
        htmls.append("<body>" + "".join(parts) + "</body>")
        wanted.append(loop_sections(events))
    made = S.page_sections(S.with_main(with_nodes(pages(spark, htmls)), body())).where("block_type <> 'full_text_backup'")
    got = {}
    for r in made.orderBy("page_id", "section_pos").collect():
        got.setdefault(r.page_id, []).append((" > ".join(r.heading_path), r.block_type, r.text))
    for i, sections in enumerate(wanted):
        assert got.get(i, []) == sections, htmls[i]


def test_content_choice(spark):
    long = "가" * 90
    htmls = [f"<body><div class='content'>{long}</div><main>{long} 신청방법 수수료</main></body>",
             f"<body><div id='content'>{long}</div><article>{long}</article></body>", "<body>짧은</body>",
             f"<body><div class='content'>{'나' * 60}</div><div id='contents'>짧은</div></body>"]
    nodes = with_nodes(pages(spark, htmls))
    tag = nodes.select("page_id", F.get("nodes", S.best_content(F.col("nodes")))["tag"].alias("best"),
                       F.get("nodes", S.first_content(F.col("nodes")))["names"].alias("first"),
                       F.get("nodes", S.longest_content(F.col("nodes")))["tag"].alias("longest"))
    got = {r.page_id: r for r in tag.collect()}
    assert [got[i].best for i in range(4)] == ["main", "div", "body", "body"]
    assert got[3].first == ["div", ".content"]
    assert got[0].longest == "body"


def test_titles(spark):
    htmls = ["<title> | 민원 안내 상세 | x</title>", "<title>메뉴</title><h1>서브 메뉴</h1><h2>둘째 제목</h2>",
             "<title></title><div class=titArea><p>y</p><h3>x</h3></div>", "<body>없음</body>",
             "<title>Our District Office</title><div class='subject'>주제 목록</div>"]
    got = with_nodes(pages(spark, htmls)).select("page_id", L.page_title(F.col("nodes")).alias("t")).orderBy("page_id").collect()
    assert [r.t for r in got] == ["민원 안내", "둘째 제목", "", "", "주제"]


def test_menu_links(spark):
    html = ("<a href='javascript:go()' onclick=\"goMenu('0104010000')\">숨은 메뉴</a><a href='/portal/contents.do?mId=0407000000'>체육</a>"
            "<a href='mailto:a@b'>m</a><a href='https://other.kr/portal/contents.do?mId=01'>밖</a>"
            "<a href='list.do?x=1&mId=0301000000#a'>목록</a><a href='./bbs/list.do?mId=0301000000'>알림 2019</a>"
            "<a href='./bbs/../bbs/list.do?mId=0301000000'>알림</a><a href='/portal/bbs/list.do?mId=0301000000'>전자민원</a>"
            "<a href='/portal/contents.do?mId=0101' title='제목 선택됨'></a>")
    rows = L.anchor_rows(with_nodes(pages(spark, [html])))
    found = L.menu_links(rows, F.array(F.lit("전자민원"))).orderBy("pos").collect()
    base = "https://www.portal.example.kr/portal/"
    # a ten-digit menu id anywhere in an anchor makes it a menu link, listings included
    assert [(r.link_url, r.anchor_text, r.menu_path) for r in found] == [
        (base + "contents.do?mId=0104010000", "숨은 메뉴", ["전자민원", "숨은 메뉴"]),
        (base + "contents.do?mId=0301000000", "목록", ["전자민원", "목록"]),
        (base + "contents.do?mId=0101", "제목", ["전자민원", "제목"])]


def test_attachments(spark):
    html = ("<li>서식 안내.hwp <a onclick=\"fn_egov_downFile_pubc('F1', '2')\">다운로드</a></li>"
            "<p><a href='/f/b.PDF#x' download='둘째.pdf'>내려받기</a></p><p><a href='/x/download?id=1'>다운로드</a></p>"
            "<p><a href='#'>a.pdf</a></p><p><a href='/f/b.PDF' download='둘째.pdf'>다시</a></p><p><a href='/plain'>x</a></p>")
    nodes = with_nodes(pages(spark, [f"<body>{html}</body>"]))
    found = nodes.select(F.inline(L.page_attachments(L.anchors(F.col("nodes")), F.col("url")))).collect()
    root = "https://www.portal.example.kr"
    assert [(r.filename, r.file_url, r.extension, r.file_id) for r in found] == [
        ("안내.hwp", root + "/cmm/fms/FileDown.do?atchFileId=F1&fileSn=2", "hwp", "F1"),
        ("둘째.pdf", root + "/f/b.PDF", "pdf", ""), ("첨부파일", root + "/x/download?id=1", "", "")]


def test_listing_lookups(spark):
    html = ("<a href='/portal/civil/view.do?civilId=1&mId=2#x'>a</a><a href='/portal/civil/view.do?civilId=1&mId=2'>b</a>"
            "<a href='/x/OfrNotAncmtLSub.jsp?c=02'>목록</a>")
    row = with_nodes(pages(spark, [html])).select(
        L.form_view_links(L.anchors(F.col("nodes")), F.col("url")).alias("v"),
        L.notice_list_url(L.anchors(F.col("nodes")), F.col("url")).alias("n")).first()
    assert row.v == ["https://www.portal.example.kr/portal/civil/view.do?civilId=1&mId=2"]
    assert row.n == "https://www.portal.example.kr/x/OfrNotAncmtLSub.jsp?c=02"


def test_start_page_shortcuts_become_documents(spark):
    url = lx.DEFAULT_PROFILE.seeds[0][0]
    html = "<nav><a href='https://c.org/x' target='_blank'>계약정보공개 새창으로열림</a><a href='https://d.org' target='_blank'>기타</a></nav><body>x</body>"
    nodes = S.with_main(with_nodes(pages(spark, [html], url)), body())
    found = L.page_shortcuts(nodes, [url]).withColumn("menu_path", F.array(F.lit("전자민원")))
    docs = L.shortcut_documents(found.withColumn("ord", F.col("n")), "ord").collect()
    assert [(d.title, d.url, d.source_url, d.page_type) for d in docs] == [("계약정보공개", "https://c.org/x", url, "menu_shortcut")]
    assert docs[0].text.split("\n")[:3] == ["제목: 계약정보공개", " 상위문서:", " 메뉴경로: 전자민원"]


def loop_frontier(seeds, links, cap):
    queue, queued, visited = list(seeds), set(seeds), []
    while queue and len(visited) < cap:
        page = queue.pop(0)
        visited.append(page)
        for link in links.get(page, []):
            if link not in queued:
                queued.add(link)
                queue.append(link)
    return set(visited)


def test_frontier_visits_breadth_first_up_to_the_cap(spark):
    rnd = random.Random(6)
    names = [f"u{i}" for i in range(30)]
    links = {n: list(dict.fromkeys(rnd.choice(names) for _ in range(rnd.randint(0, 4)))) for n in names}
    table = spark.createDataFrame([(u, i, v, f"t{v}") for u, vs in links.items() for i, v in enumerate(vs)],
                                  "url string, pos bigint, link_url string, anchor_text string")
    seeds = spark.createDataFrame([("u0", ["s"], 0), ("u1", ["t"], 1)], "url string, menu_path array<string>, seq int")
    for cap in (1, 7, 100):
        got = expand_frontier(seeds, table, cap).collect()
        assert {r.url for r in got} == loop_frontier(["u0", "u1"], links, cap)
        assert all(r.menu_path[0] in "st" for r in got)


def test_file_inventory(spark, tmp_path):
    for name in ("여권 발급_신청서.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = sorted((r.file_name, r.title) for r in file_inventory(spark, str(tmp_path)).collect())
    assert got == [("b.PDF", "b"), ("여권 발급_신청서.pdf", "여권 발급 신청서")]


def test_frontier_visits_repeated_seeds_once(spark):
    from gleaner.operators.frontier import expand_frontier

    seeds = spark.createDataFrame([("a", ["x"], 1), ("a", ["y"], 0), ("b", ["z"], 2)], "url string, menu_path array<string>, seq long")
    links = spark.createDataFrame([("a", 0, "c", "C"), ("b", 0, "a", "A"), ("c", 0, "b", "B")],
                                  "url string, pos long, link_url string, anchor_text string")
    got = {r["url"]: r["menu_path"] for r in expand_frontier(seeds, links).collect()}
    assert got == {"a": ["y"], "b": ["z"], "c": ["y", "C"]}


def test_saved_documents_keep_the_first_of_an_id(spark):
    from gleaner.plans.documents import saved_documents

    text = "내용 " * 60
    url = "https://www.portal.example.kr/portal/contents.do?mId=0101"
    rows = [("d", url, "", text, 5, i) for i in (2, 1, 3)] + [("e", url, "", text, 5, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, url string, anchor_text string, text string, score int, seq long")
    assert sorted(r["seq"] for r in saved_documents(docs, order="seq").collect()) == [1, 9]
    assert saved_documents(docs).count() == 4


def test_plain_markup_is_read_as_the_parser_reads_it(monkeypatch):
    from gleaner.sources import pages as G

    pieces = ["<p>", "</p>", "<P class='a b'>", "<br>", "<br/>", "text", "a & b", "&amp;", "&lt", "<", "<!-- c -->", "<!---->", "<!doctype html>",
              "<script>", "</script>", "<title>", "</title>", "x<y", " \n", "<td rowspan=2 colspan=\"3\">", "<a href=\"/x?a=1&b=2\">", "<a href='/y'>",
              "</a>", "<li>", "<ul>", "</ul>", "<textarea>", "</textarea>", "<a href=x/>", "<input disabled>", "<İ>", "<nav>", "</nav>", "<p a= b>", "<plaintext>", "\x1c"]
    rng, noise, plain = random.Random(5), frozenset(["nav"]), G._plain_tokens
    pages = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(4000)]
    quick = [G._Nodes(noise).finish(x) for x in pages]
    monkeypatch.setattr(G, "_plain_tokens", lambda html: None)
    assert quick == [G._Nodes(noise).finish(x) for x in pages]
    assert 500 < sum(plain(x) is not None for x in pages) < 3500
    monkeypatch.setattr(G, "_plain_tokens", plain)
    monkeypatch.setattr(G._Nodes, "feed", lambda *_: pytest.fail("plain markup went through the parser"))
    assert [r[4] for r in G._Nodes(noise).finish("<body><nav id=a>x</nav><script>y</script>z<br></body>")] == [
        "body", "nav", "#text", "script", "#hidden", "#text", "br"]


def test_views_of_a_table_are_those_of_its_kind(spark):
    from gleaner.operators import tables as X
    from gleaner.sources.pages import with_nodes

    html = ("<body><table><caption>대형폐기물 수집 및 운반 처리 수수료</caption><tbody><tr><td>가</td></tr></tbody></table>"
            "<table><tr><th>품목</th><td>나</td></tr></table></body>")
    pages = with_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).withColumn("main", F.get("nodes", F.lit(0)))
    fee, general = sorted(X.page_tables(pages).collect(), key=lambda r: r["pos"])
    assert (fee["kind"], general["kind"]) == ("fee", "general")
    assert (fee["grid"], general["grid"]) == ([["가"]], [["품목", "나"]])
    assert {r[c] for r in (fee, general) for c in ("head", "body_flat", "body_lines", "flat")} == {None}
