"""Crawls over the pages' own links, and the whole page job on a site made of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.catalog.pages import _ANCHORS, _PORTAL_LINK, _plain
from gleaner.operators import links as L
from gleaner.operators.frontier import expand_frontier
from gleaner.plans.site import site_documents as site_job
from gleaner.session import shared_folder, written
from gleaner.sources.jsonl import read_documents, write_documents
from gleaner.sources.pages import with_nodes

_PROFILE = lx.DEFAULT_PROFILE
_LEVELS = 14  # more than any of the given tables needs; the counterpart has a fixed number of rounds

# A page is known by the last word of its own menu. Several pages share a word (the first counts), many words have no page.
_NAV = "<nav>(.*?)</nav>"
_SLUG = f"""list_extract(regexp_extract_all(regexp_extract(html, {q.rx(_NAV)}, 1), 'href="/([^"]*)"', 1), -1)"""
_SLUGS = f"""k as (select min(page_id) as page_id, {q.lit(_PORTAL_LINK)} || {_plain(_SLUG)} as url from pages
    where {_SLUG} is not null group by 2)"""


def _slug():
    nav = F.regexp_extract("html", _NAV, 1)
    word = F.try_element_at(F.regexp_extract_all(nav, F.lit('href="/([^"]*)"'), F.lit(1)), F.lit(-1))
    return F.replace(F.replace(word, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def _linked_pages(t):
    """Pages whose menus lead to one another."""
    html = F.regexp_replace("html", r'href="/([^"]*)"', 'href="contents.do?mId=01&p=$1"')
    named = t("pages").withColumn("slug", _slug()).where("slug is not null")
    return named.select("page_id", F.concat(F.lit(_PORTAL_LINK), "slug").alias("url"), html.alias("html"))


def _rounds(first: str, links: str, levels: int) -> str:
    """Levels v1, v2, .. after ``v0`` (url, parent_url, anchor_text, menu_path, visit): links are taken in visiting order, once."""
    out = []
    for i in range(1, levels):
        seen = " union all ".join(f"select url from v{j}" for j in range(i))
        out.append(f"""v{i} as materialized (select url, o.parent_url, o.anchor_text, o.menu_path, o.visit from (
    select link_url as url, arg_min({{'parent_url': url, 'anchor_text': coalesce(ext, labels[1]), 'visit': list_append(visit, pos),
      'menu_path': case when ext is null then menu_path else list_append(menu_path, ext) end}}, list_append(visit, pos)) as o
    from (select v.visit, v.menu_path, l.*, list_filter(labels, lambda x: x <> '' and length(x) <= 60 and not list_contains(v.menu_path, x))[1] as ext
      from v{i - 1} as v join {links} as l using (url)) group by 1) where url not in ({seen}))""")
    every = " union all ".join(f"select {i} as depth, * from v{i}" for i in range(levels))
    return ", ".join([first, *out, f"v as (select *, visit as place from ({every}))"])


def _link_table(name: str, pages: str, anchors: str) -> str:
    return f"""{name} as (select url, link_url, min(n)::bigint as pos, list(label order by n) as labels from (
    select {pages}.url, {q.lit(_PORTAL_LINK)} || substr({_plain('href')}, 2) as link_url, {q.inline(_plain('raw'))} as label, n
    from {anchors} join {pages} using (page_id)) where not regexp_matches(lower(link_url), {q.words(lx.DENY_URL_WORDS)}) group by 1, 2)"""


@query(f"""with {_ANCHORS.replace('page_id, url,', 'page_id,')}, {_SLUGS}, {_link_table('l', 'k', 'a')},
  {_rounds(f"v0 as (select url, '' as parent_url, '전자민원' as anchor_text, ['전자민원'] as menu_path, [0::bigint] as visit from k where page_id = (select min(page_id) from k))", 'l', _LEVELS)}
  select k.page_id, v.url, v.depth, v.parent_url, v.anchor_text, array_to_string(v.menu_path, ' > ') as menu_path from v left join k using (url)""")
def frontier(t):
    """The pages reached from the first one over the links in their html; links may lead back, twice to one page or to none."""
    pages = _linked_pages(t)
    first = pages.groupBy("url").agg(F.min("page_id").alias("page_id"))
    pages = written(pages.join(first, ["url", "page_id"], "left_semi"), "linked-pages")
    links = L.page_links(L.anchor_rows(with_nodes(pages)))
    seeds = first.agg(F.min_by("url", "page_id").alias("url")).where("url is not null").select(
        "url", F.array(F.lit("전자민원")).alias("menu_path"), F.lit(0).alias("seq"))
    found = expand_frontier(seeds, links)
    return found.join(first, "url", "left").select("page_id", "url", "depth", "parent_url", "anchor_text", F.array_join("menu_path", " > ").alias("menu_path"))


# -- a whole site -----------------------------------------------------------------------------
#
# One start page links two posts, a board per document source, and the first three content pages, which link one another by their own
# menus. A board's listing pages hold the documents of 200 ids each, newest first, a day per two ids back from a fixed date; some
# rows are undated, every fiftieth leads to the same post. Some posts have no page, some pages hold next to no text.

_BASE = _PROFILE.base_url
_START = f"{_BASE}/portal/contents.do?mId=0101"
_LIST, _VIEW = f"{_BASE}/portal/bbs/list.do?mId=01&b=", f"{_BASE}/portal/bbs/view.do?mId=01&n="
_HELP = "주민이며 방문하여 신청하시면 됩니다 수수료는 없으며 처리기간은 삼 일입니다 자세한 내용은 창구로 문의하시거나 누리집을 보시기 바랍니다"
_NEWEST, _PER_PAGE = "2026-05-10", 200


def _text(c):
    return F.col(c).cast("string")


def _content_html(nav):
    i = _text("page_id")
    body = F.when(F.col("page_id") % 7 == 3, F.lit("짧은 쪽")).otherwise(F.concat(
        F.lit("신청대상은 "), i, F.lit(f" 번 {_HELP}<p><a href='https://a.org/"), (F.abs("page_id") % 40).cast("string"), F.lit("'>예약 창구 "),
        (F.abs("page_id") % 3).cast("string"), F.lit("</a></p>")))
    return F.concat(F.lit("<html><head><title>쪽 "), i, F.lit(" 안내 | 누리집</title></head><body><nav>"), nav, F.lit("</nav><div id=contents>"), body,
                    F.lit("</div></body></html>"))


def _site(t):
    """(page_id, url, html) of the site; page_id orders pages of one url."""
    nav = F.regexp_replace(F.regexp_extract("html", _NAV, 1), r'href="/([^"]*)"', 'href="contents.do?mId=01&p=$1"')
    named = t("pages").withColumn("slug", _slug()).where("slug is not null")
    content = named.select("page_id", F.concat(F.lit(_PORTAL_LINK), "slug").alias("url"), _content_html(nav).alias("html"))
    docs = t("documents").select("doc_id", "source", "lang", "n_chars")
    newest = docs.agg(F.max("doc_id").alias("newest"))
    back = F.col("newest") - F.col("doc_id")
    docs = docs.join(F.broadcast(newest), F.lit(True)).withColumn("page_no", F.floor(back / _PER_PAGE).cast("long") + 1)
    day = F.when(F.col("doc_id") % 37 == 4, F.lit("")).otherwise(
        F.date_format(F.date_sub(F.lit(_NEWEST).cast("date"), F.floor(back / 2).cast("int")), "yyyy.MM.dd"))
    target = F.when(F.col("doc_id") % 50 == 0, F.lit(0)).otherwise(F.col("doc_id")).cast("string")
    row = F.concat(F.lit("<tr><td>"), _text("doc_id"), F.lit("</td><td><a href='view.do?mId=01&n="), target, F.lit("'>글 "), _text("doc_id"), F.lit("</a></td><td>"),
                   F.col("lang"), F.lit("과</td><td>"), day, F.lit("</td><td>"), _text("n_chars"), F.lit("</td></tr>"))
    rows = docs.groupBy("source", "page_no").agg(F.array_sort(F.collect_list(F.struct(back.alias("back"), row.alias("row")))).alias("rows"))
    listing = rows.select(
        F.col("page_no").alias("page_id"), F.concat(F.lit(_LIST), "source", F.when(F.col("page_no") > 1, F.concat(F.lit("&page="), _text("page_no"))).otherwise("")).alias("url"),
        F.concat(F.lit("<table><tr><th>번호</th><th>제목</th><th>부서</th><th>작성일</th><th>조회</th></tr>"), F.array_join("rows.row", ""), F.lit("</table>")).alias("html"))
    body = F.when(F.col("doc_id") % 5 == 3, F.lit("짧은 글")).otherwise(F.concat(F.col("lang"), F.lit(" 안내문 "), _text("doc_id"), F.lit(f" 신청대상은 {_HELP}")))
    posts = docs.where("doc_id % 11 <> 5").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit(_VIEW), _text("doc_id")).alias("url"),
        F.concat(F.lit("<html><head><title>상세 "), _text("doc_id"), F.lit("</title></head><body><div id=contents>"), body, F.lit("</div></body></html>")).alias("html"))

    def post(text, n):
        return F.concat(F.lit("<a href='/portal/bbs/view.do?mId=01&n="), (F.col("newest") - n).cast("string"), F.lit(f"'>{text}</a>"))

    boards = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("<a href='/portal/bbs/list.do?mId=01&b="), s, F.lit("'>"), s, F.lit(" 게시판</a>"))), "")
    shown = F.array_join(F.transform("slugs", lambda s: F.concat(F.lit('<a href="contents.do?mId=01&p='), s["slug"], F.lit('">'), s["slug"], F.lit("</a>"))), "")
    slugs = named.where("page_id < 3").agg(F.array_sort(F.collect_list(F.struct("page_id", "slug"))).alias("slugs"))
    sources = docs.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("newest").alias("newest"))
    start = sources.join(slugs, F.lit(True)).withColumn("page_id", F.lit(-1).cast("long"))
    menu = F.concat(post("글 링크", 7), boards, post("나중 글", 8), F.lit("<a href='https://c.org/x' target='_blank'>계약정보공개 새창으로열림</a>"), shown)
    start = start.select("page_id", F.lit(_START).alias("url"), _content_html(menu).alias("html"))
    return start.unionByName(content).unionByName(listing).unionByName(posts)


_COLUMNS = ["record", "doc_id", "url", "parent_url", "anchor_text", "menu_path", "title", "department", "day", "views", "board_number", "text"]


def _lines(*parts: str) -> str:
    """Document text: its lines longer than one letter."""
    return f"array_to_string(list_filter(string_split({' || chr(10) || '.join(parts)}, chr(10)), lambda l: length(l) > 1), chr(10))"


_SITE_TEXT = _lines("'제목: ' || title", "'메뉴경로: ' || array_to_string(menu_path, ' > ')", "'[섹션 구조]'", "'전체 본문'", "'[전체 본문]'", "body")
_SITE_SQL = f"""with {_ANCHORS.replace('page_id, url,', 'page_id,').replace('from pages', f"from (select page_id, regexp_extract(html, {q.rx(_NAV)}, 1) as html from pages)")},
  {_SLUGS}, {_link_table('c', 'k', 'a')}, m as (select max(doc_id) as newest from documents),
  b as (select source, row_number() over (order by source) as pos from (select distinct source from documents where source is not null)),
  s as (select {q.lit(_START)} as url, * from (
    select {q.lit(_VIEW)} || newest - 7 as link_url, 0 as pos, '글 링크' as label from m
    union all select {q.lit(_LIST)} || source, pos, source || ' 게시판' from b
    union all select {q.lit(_VIEW)} || newest - 8, 1000000, '나중 글' from m
    union all select {q.lit(_PORTAL_LINK)} || {_plain(_SLUG)}, 1000001 + page_id, {q.inline(_plain(_SLUG))} from pages where page_id < 3 and {_SLUG} is not null)),
  l as (select url, link_url, pos, labels from c union all select url, link_url, min(pos)::bigint, list(label order by pos) from s
    where not regexp_matches(lower(link_url), {q.words(lx.DENY_URL_WORDS)}) group by 1, 2),
  r as (select source, doc_id, (newest - doc_id) // {_PER_PAGE} + 1 as page_no, newest - doc_id as row_no, lang, n_chars, case when doc_id % 37 = 4 then null
    else date {q.lit(_NEWEST)} - ((newest - doc_id) // 2)::int end as day, {q.lit(_VIEW)} || case when doc_id % 50 = 0 then 0 else doc_id end as url from documents, m),
  j as (select *, day is null or day >= date {q.lit(lx.RECENT_AS_OF)} - {lx.RECENT_DAYS} as recent from r),
  g as (select source, page_no, bool_or(recent) as any_recent from j group by 1, 2),
  e as (select *, page_no = row_number() over w as dense, coalesce(bool_or(not any_recent) over (partition by source order by page_no
    rows between unbounded preceding and 1 preceding), false) as ended from g window w as (partition by source order by page_no)),
  shown as (select j.*, b.pos from j join e using (source, page_no) join b using (source) where recent and dense and not ended),
  first as (select url, arg_min({{'source': source, 'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'day': day, 'pos': pos}}, [pos, page_no, row_no]) as o
    from shown where url <> (select {q.lit(_VIEW)} || newest - 7 from m) group by 1),
  {_rounds(f"v0 as (select {q.lit(_START)} as url, '' as parent_url, '시작' as anchor_text, ['시작'] as menu_path, [0::bigint] as visit)", 'l', _LEVELS)},
  reached as (select * from v where url not in (select url from first)),
  pages_ as (select -1 as page_id, {q.lit(_START)} as url union all select page_id, url from k),
  content as (select p.page_id as i, v.*, '쪽 ' || p.page_id || ' 안내' as title, case when p.page_id % 7 = 3 then '짧은 쪽' else '신청대상은 ' || p.page_id || ' 번 '
    || {q.lit(_HELP)} || chr(10) || '예약 창구 ' || abs(p.page_id) % 3 || chr(10) || '[바로가기 링크]' || chr(10) || '- 예약 창구 ' || abs(p.page_id) % 3 || ': https://a.org/' || abs(p.page_id) % 40
    end as body, 2 as points from reached v join pages_ p using (url)),
  posts as (select doc_id as i, {q.lit(_VIEW)} || doc_id as url, '상세 ' || doc_id as title, case when doc_id % 5 = 3 then '짧은 글' else lang || ' 안내문 ' || doc_id || ' 신청대상은 '
    || {q.lit(_HELP)} end as body from documents where doc_id % 11 <> 5),
  queued as (select p.i, v.*, title, body, 4 as points from reached v join posts p using (url)),
  made as (select *, {_SITE_TEXT} as text from (select * from content union all select * from queued)),
  scored as (select *, points + 1 + (length(text) >= 200)::int * 2 + (length(text) >= 500)::int * 2 + 1 + regexp_matches(text, {q.words(lx.SECTION_HINTS)})::int * 3
    - ({q.count_words('text', _PROFILE.menu_signals)} >= 3 or len(list_filter(string_split(text, chr(10)), lambda x: length(x) <= 12)) > len(string_split(text, chr(10))) * 0.70)::int * 5 as score from made),
  boarded as (select f.url, {q.lit(_LIST)} || o.source as parent_url, '글 ' || o.doc_id as anchor_text, list_append(v.menu_path, '글 ' || o.doc_id) as menu_path, o, p.title, p.body
    from first f join posts p using (url) join v on v.url = {q.lit(_LIST)} || o.source),
  found as (select {{'url': url, 'menu_path': menu_path, 'place': [depth, place]}} as o, '예약 창구 ' || abs(i) % 3 as label, 'https://a.org/' || abs(i) % 40 as link, 0 as n from content where i % 7 <> 3
    union all select {{'url': url, 'menu_path': menu_path, 'place': [depth, place]}}, '계약정보공개', 'https://c.org/x', 1 from content where i = -1),
  short as (select link, f.o.url as page, f.o.menu_path as menu_path, f.label from (select link, arg_min({{'o': o, 'label': label}}, {{'a': o.depth, 'b': o.place, 'c': n}}) as f from found group by 1))
  select 'page' as record, md5(url) as doc_id, url, parent_url, anchor_text, array_to_string(menu_path, ' > ') as menu_path, title, '' as department, '' as day, null::bigint as views,
    null as board_number, text from scored where length(text) >= 80 and score >= 0
  union all select 'page', md5(url), url, parent_url, anchor_text, array_to_string(menu_path, ' > '), anchor_text, case when o.day is null then '' else o.lang || '과' end, coalesce(o.day::varchar, ''), o.n_chars, o.doc_id::varchar, text
    from (select *, {_SITE_TEXT} as text from boarded) where length(text) >= 80
  union all select 'shortcut', md5(page || '|shortcut|' || label || '|' || link), link, page, label, array_to_string(menu_path, ' > '), label, null, null, null, null,
    '제목: ' || label || chr(10) || ' 상위문서:' || chr(10) || ' 메뉴경로: ' || array_to_string(menu_path, ' > ') || chr(10) || ' 분류: 바로가기 링크' || chr(10) || ' 바로가기명: ' || label
      || chr(10) || ' 바로가기URL: ' || link || chr(10) || ' 원본페이지: ' || page from short"""
_SITE_SQL = _SITE_SQL.replace("'place': [depth, place]}", "'depth': depth, 'place': place}")


@query(_SITE_SQL)
def site_documents(t):
    """Every document and shortcut a crawl of the site saves, written as JSON lines and read back."""
    pages = written(_site(t), "site-snapshot")
    spark = pages.sparkSession
    seeds = spark.range(1).select(F.lit(_START).alias("url"), F.array(F.lit("시작")).alias("menu_path"), F.lit(0).alias("seq"))
    site = site_job(pages, seeds)
    folder = f"{shared_folder(spark).rstrip('/')}/site-documents-{uuid.uuid4().hex}"
    write_documents(site.pages, site.shortcuts, folder)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (
        "record", "doc_id", "url", "source_url", "parent_url", "anchor_text", "title", "department", "date", "board_number", "text")] + [
        T.StructField("menu_path", T.ArrayType(T.StringType())), T.StructField("views", T.LongType())])
    back = read_documents(spark, folder, schema)
    return back.select("record", "doc_id", "url", F.coalesce("parent_url", "source_url").alias("parent_url"), F.coalesce("anchor_text", "title").alias("anchor_text"),
                       F.array_join("menu_path", " > ").alias("menu_path"), "title", "department", F.col("date").alias("day"), "views", "board_number", "text")
