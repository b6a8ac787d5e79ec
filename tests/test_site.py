"""Crawls with boards against a plain loop, the visited table, and array folds on large pages."""

import collections
import random
import time

from gleaner.operators import links as L
from gleaner.operators.frontier import Visited, expand_frontier
from gleaner.plans.site import board_pages, site_documents
from pyspark.sql import functions as F


def loop_crawl(seeds, links, boards):
    """{url: (parent, label, path, board row)} by visiting one page after the other."""
    seen, out, queued = set(), {}, set()
    queue = collections.deque()
    for url, path in seeds:
        queue.append((url, "", path[-1], path))
        queued.add(url)
    while queue:
        url, parent, label, path = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        out[url] = (parent, label, path, None)
        for page, row, target, title in sorted(boards.get(url, [])):
            if target not in seen:
                seen.add(target)
                out[target] = (url, title, [*path, title], (page, row))
        found = {}
        for _, target, label in sorted(links.get(url, [])):
            extended = [*path, label] if label and label not in path and len(label) <= 60 else path
            if target not in found or len(extended) > len(found[target][1]):
                found[target] = (label, extended)
        for target, (label, extended) in found.items():
            if target not in seen and target not in queued:
                queue.append((target, url, label, extended))
                queued.add(target)
    return out


def test_crawls_with_boards_equal_the_loop(spark):
    rng = random.Random(12)
    for size, n_boards in ((12, 4), (25, 0)):
        urls = [f"u{i}" for i in range(size)]
        links = {u: [(n, rng.choice(urls), rng.choice(["a", "b", "c", "", "x" * 61])) for n in range(rng.randint(0, 4))] for u in urls[:-3]}
        boards = {b: [(p, r, rng.choice(urls + ["v1", "v2", b]), f"t{p}{r}") for p in (1, 2) for r in range(3)] for b in rng.sample(urls, n_boards)}
        seeds = [("u0", ["s"]), ("u1", ["s", "a"]), ("u0", ["again"])]
        rows = collections.defaultdict(list)
        for u, found in links.items():
            for n, target, label in found:
                rows[u, target].append((n, label))
        table = spark.createDataFrame([(u, min(x)[0], v, [label for _, label in sorted(x)]) for (u, v), x in rows.items()],
                                      "url string, pos long, link_url string, labels array<string>")
        claims = spark.createDataFrame([(b, v, p, r, t) for b, shown in boards.items() for p, r, v, t in shown],
                                       "board string, url string, page_no long, row_no long, title string")
        start = spark.createDataFrame([(u, p, i) for i, (u, p) in enumerate(seeds)], "url string, menu_path array<string>, seq int")
        got = expand_frontier(start, table, claims=claims).collect()
        assert len({r["url"] for r in got}) == len(got)
        plain = loop_crawl(seeds, links, boards)
        assert {r["url"]: (r["parent_url"], r["anchor_text"], r["menu_path"], None if r["page_no"] is None else (r["page_no"], r["row_no"]))
                for r in got} == plain


def test_visited_reads_only_buckets_that_may_hold_a_url(spark):
    visited = Visited(spark, log2_buckets=5)
    urls = spark.range(3000).select(F.concat(F.lit("https://a.org/"), F.col("id").cast("string")).alias("url"))
    visited.add(urls.where("id < 2000"))
    fresh = visited.fresh(urls.where("id >= 1990 and id < 2010").select("url"))
    assert sorted(int(r[0].rsplit("/", 1)[1]) for r in fresh.collect()) == list(range(2000, 2010))
    held = {r[0] for r in urls.where("id >= 1990 and id < 2000").select(F.xxhash64("url").bitwiseAND(F.lit(31))).collect()}
    assert held <= set(visited.asked) and len(visited.asked) < 20
    fresh = visited.fresh(urls.where("id = 5"))
    assert fresh.count() == 0 and len(visited.asked) == 1
    assert {f.split("bucket=")[1].split("/")[0] for f in spark.read.schema("url string, bucket int").parquet(visited.folder).where(
        F.col("bucket").isin(visited.asked)).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {str(visited.asked[0])}
    visited.add(urls.where("id >= 2000"))
    assert visited.fresh(urls).count() == 0


def test_folds_of_a_large_page(spark):
    rng = random.Random(1)
    items = [(rng.choice("abc") + str(rng.randint(0, 4000)), f"u{rng.randint(0, 3)}", f"r{i}") for i in range(10_000)]
    df = spark.createDataFrame([(items,), ([],)], L.SHORTCUTS.join(["found ", ""]))
    start = time.perf_counter()
    first, last = df.where("size(found) > 0").select(L.first_by(F.col("found"), "text", "url").alias("f"), L.last_value_by(F.col("found"), "text", "url").alias("l")).first()
    assert time.perf_counter() - start < 20
    plain = {}
    for i in items:
        plain.setdefault(i[:2], i)
    assert list(map(tuple, first)) == list(plain.values())
    assert list(map(tuple, last)) == list({i[:2]: i for i in items}.values())
    assert df.where("size(found) = 0").select(L.last_value_by(F.col("found"), "text")).first()[0] == []


def test_board_pages_are_numbered_by_their_urls(spark):
    df = spark.createDataFrame([("https://h/l.do",), ("https://h/l.do?page=3",), ("https://h/l.do?b=1&page=1",), ("https://h/l.do?b=1&page=x",)], "url string")
    assert sorted(map(tuple, board_pages(df).collect())) == sorted([(u, 1, u) for u, in df.collect()] + [("https://h/l.do", 3, "https://h/l.do?page=3")])


def test_odd_snapshots(spark):
    base = "https://www.portal.example.kr/portal/contents.do?mId=01"
    text = "신청대상은 주민이며 방문하여 신청하시면 됩니다 수수료는 없으며 처리기간은 삼 일입니다 자세한 내용은 아래를 보시기 바랍니다 문의는 전화로 하시면 됩니다 고맙습니다"
    link = f"<a href='{base}&x=2'>둘째</a><a href='{base}&x=3'>셋째</a><a href='{base}'>처음</a><a href='{base}&x=4'>없음</a>"
    page = f"<body><nav>{link}</nav><div id=contents>{text}</div></body>"
    rows = [(1, base, page, "text/html"), (2, base, "<p>later copy</p>", None), (3, None, page, None), (4, f"{base}&x=2", None, ""),
            (5, f"{base}&x=3", page, "application/pdf"), (6, f"{base}&unreached", page, "text/html")]
    snapshot = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string")
    seeds = spark.createDataFrame([(base, ["처음"], 0)], "url string, menu_path array<string>, seq int")
    site = site_documents(snapshot, seeds)
    assert [r["url"] for r in site.pages.collect()] == [base] and site.shortcuts.count() == 0
    assert {r["url"] for r in site.visits.collect()} == {base, f"{base}&x=2", f"{base}&x=3", f"{base}&x=4"}
    empty = site_documents(snapshot.limit(0), seeds)
    assert empty.pages.count() == 0 and empty.visits.count() == 1
