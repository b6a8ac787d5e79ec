"""Page jobs over the page snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.catalog.rules import is_heading
from gleaner.functions import dom as D
from gleaner.functions import urls as U
from gleaner.operators import links as L
from gleaner.operators import sections as S
from gleaner.sources.pages import with_nodes

_PROFILE = lx.DEFAULT_PROFILE


def _plain(x):
    # the last semicolon of a text may be missing
    return q.sub(q.sub(x, "&quot;?", "'\"'"), "&amp;?", "'&'")


def _tag(name):
    return q.inline(_plain(f"regexp_extract(html, '<{name}>([^<]*)</{name}>', 1)"))


@query(f"""with p as (select page_id, list_filter(list_transform(string_split({_tag('title')}, '|'), lambda x: {q.inline('x')}),
    lambda x: x <> '')[1] as head, {_tag('h1')} as h1 from pages)
  select page_id, case when length(head) between 2 and 120 then head when length(h1) between 2 and 120 then h1 else '' end
    as title from p""")
def page_titles(t):
    return with_nodes(t("pages")).select("page_id", L.page_title(F.col("nodes")).alias("title"))


_A = '<a href="([^"]*)">([^<]*)</a>'
_ANCHORS = f"""a as (select page_id, url, unnest(regexp_extract_all(html, {q.rx(_A)}, 1)) as href,
    unnest(regexp_extract_all(html, {q.rx(_A)}, 2)) as raw,
    unnest(range(len(regexp_extract_all(html, {q.rx(_A)})))) as n from pages)"""


@query(f"""with {_ANCHORS} select page_id, n, {_plain('href')} as href, {q.inline(_plain('raw'))} as label,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || {_plain('href')} as link from a""")
def page_anchors(t):
    rows = with_nodes(t("pages")).select("page_id", "url", F.posexplode(L.anchors(F.col("nodes"))).alias("n", "a"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), "a.href", F.col("a.text").alias("label"),
                       U.resolve(F.col("url"), F.col("a.href")).alias("link"))


@query("""select page_id, len(regexp_extract_all(html, '<h1[ >]')) as n_h1, len(regexp_extract_all(html, '<p[ >]')) as n_p,
  len(regexp_extract_all(html, '<li[ >]')) as n_li, len(regexp_extract_all(html, '<!--')) as n_comments from pages""")
def page_nodes(t):
    def count(tag):
        return F.size(F.filter("nodes", lambda n: n["tag"] == tag)).cast("long")

    return with_nodes(t("pages")).select("page_id", count("h1").alias("n_h1"), count("p").alias("n_p"),
                                         count("li").alias("n_li"), count("#comment").alias("n_comments"))


# The content of the given pages is their article, or the body without its noise where the article is short. The only heading is
# the article's first one; the strings from it on are one paragraph below it.
_ARTICLE = "regexp_extract(html, '<article>((?s:.)*)</article>', 1)"
_BODY = q.sub("regexp_extract(html, '<body[^>]*>((?s:.)*)', 1)", "<(nav|footer|header|aside|script|style)[ >](?s:.)*?</(nav|footer|header|aside|script|style)>", "chr(10)")


def _strings(x):
    return _plain(q.sub(q.sub(x, "<!--(?s:.)*?-->", "chr(10)"), "<[^>]*>", "chr(10)"))


_KEPT = (f"list_filter({q.line_list('x')}, lambda l: length(l) > 1 and l not in ({q.listed(lx.NOISE_EXACT)}) "
         f"and not regexp_matches(l, '^(' || {q.words(lx.NOISE_PREFIXES)} || ')'))")
_CONTENT = f"""c as (select page_id, {_tag('h1')} as h, case when length({q.clean(q.block(_strings(_ARTICLE)))}) >= 80 then {_ARTICLE} else {_BODY} end as content from pages),
  b as (select page_id, h, {_strings('content')} as x from c),
  f as (select page_id, h, array_to_string({_KEPT}, chr(10)) as text from b where len({_KEPT}) > 0),
  r as (select page_id, h, {_strings("content[strpos(content, '<h1'):]")} as x from c where contains(content, '<h1')),
  g as (select page_id, h, {q.clean(f"array_to_string({_KEPT}, chr(10))")} as text from r)"""


@query(f"""with {_CONTENT}
  select page_id, 0 as n, '전체 본문' as path, 'full_text_backup' as block_type, text from f
  union all select page_id, 1, h, 'paragraph', text from g where {is_heading('h')} and length(text) >= 3 and text <> h""")
def page_sections(t):
    """Sections of all pages, paths and texts included, numbered within their page."""
    pages = with_nodes(t("pages"))
    found = S.collect_sections(S.page_sections(S.with_main(pages, S.best_content(F.col("nodes")))))
    rows = found.select("page_id", F.posexplode("sections").alias("n", "s"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), F.array_join("s.heading_path", " > ").alias("path"), "s.block_type", "s.text")


@query(f"with {_CONTENT} select page_id, text as full_text from f")
def page_full_text(t):
    """The backup section of every page, whatever its content node."""
    pages = with_nodes(t("pages"))
    found = S.page_sections(S.with_main(pages, S.best_content(F.col("nodes")))).where("block_type = 'full_text_backup'")
    return found.select("page_id", F.col("text").alias("full_text"))


# links pointed at portal menu pages, so that the crawl gates let them through
_PORTAL_LINK = "https://www.portal.example.kr/portal/contents.do?mId=01&p="


def portal_pages(t):
    html = F.regexp_replace("html", r'href="/([^"]*)"', 'href="contents.do?mId=01&p=$1"')
    url = F.concat(F.lit(_PORTAL_LINK), F.col("page_id").cast("string"))
    return t("pages").select("page_id", url.alias("url"), html.alias("html"))


@query(f"""with {_ANCHORS}, l as (select page_id, n, {q.lit(_PORTAL_LINK)} || substr(href, 2) as link_url,
    {q.inline(_plain('raw'))} as label from a),
  m as (select *, case when label <> '' and label <> '전자민원' and length(label) <= 60 then 2 else 1 end as size from l
    where not regexp_matches(lower(link_url), {q.words(lx.DENY_URL_WORDS)})),
  r as (select *, row_number() over (partition by page_id, link_url order by size desc, n) as k from m)
  select page_id, link_url, label as anchor_text, '전자민원' || case size when 2 then ' > ' || label else '' end as menu_path
  from r where k = 1""")
def menu_links(t):
    rows = L.anchor_rows(with_nodes(portal_pages(t)))
    found = L.menu_links(rows, F.array(F.lit("전자민원")))
    return found.select("page_id", "link_url", "anchor_text", F.array_join("menu_path", " > ").alias("menu_path"))


@query(f"""select page_id, n.value as notice_id, '' as anchor_text from (select page_id, unnest(list_distinct([page_id % 50,
  page_id % 7, page_id]))::varchar as value from pages) n""")
def notice_ids(t):
    i = F.col("page_id")

    def call(x):
        return F.concat(F.lit("javascript:searchDetail('"), x.cast("string"), F.lit("')"))

    html = F.concat(F.col("html"), F.lit('<a href="#" onclick="'), call(i % 50), F.lit('">a</a><a href="'), call(i % 7),
                    F.lit('">b</a><script>searchDetail('), i.cast("string"), F.lit(") searchDetail('x1')</script>"))
    pages = t("pages").select("page_id", html.alias("html"))
    return L.notice_ids(with_nodes(pages), pages).select("page_id", "notice_id", "anchor_text")


@query(f"""with p as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) as root from pages)
  select page_id, root || '/files/f' || page_id || '.pdf' as file_url, 'f' || page_id || '.pdf' as filename, 'pdf' as extension from p
  union all select page_id, {q.lit(_PROFILE.file_down_url)} || '?atchFileId=FILE_' || page_id || '&fileSn=1', '안내 ' || page_id || '.hwpx',
    'hwp' from p""")
def page_files(t):
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.col("html"), F.lit('<ul><li><a href="/files/f'), i, F.lit('.pdf#p">f'), i, F.lit('.pdf [1.5 MB]</a></li><li><a href="#" title="안내 '),
        i, F.lit('.hwpx" onclick="fn_egov_downFile_pubc(\'FILE_'), i, F.lit("', '1')\">다운로드</a></li><li><a href=\"/files/f"), i,
        F.lit('.pdf">f'), i, F.lit('.pdf</a></li></ul>'))
    pages = with_nodes(t("pages").select("page_id", "url", html.alias("html")))
    found = L.page_attachments(L.anchors(F.col("nodes")), F.col("url"))
    return pages.select("page_id", F.inline(found)).select("page_id", "file_url", "filename", "extension")


@query(f"""with p as (select page_id, url, regexp_extract(url, '^(https?://[^/?#]*)', 1) as root from pages)
  select page_id, 0 as n, '예약 ' || page_id as label, 'https://a.org/r' || page_id as link_url from p
  union all select page_id, 1, '안내', root || '/portal/contents.do?mId=01' from p
  union all select page_id, 2, '여권안내 홈페이지', 'https://www.passport.go.kr/x' from p
  union all select page_id, 3, '계약정보공개', 'https://c.org/' || page_id from p where page_id % 4 = 1
  union all select page_id, 4, '재정정보공개', root || '/f' from p where page_id % 4 = 1""")
def page_shortcuts(t):
    """Shortcuts of every page, and the saved new-window links of the start pages, a quarter of all."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.col("html"), F.lit('<nav><a href="https://c.org/'), i, F.lit('" target="_blank"> 계약정보공개 </a><a href="/f#x">재정정보공개 새창</a>'
                             '<a href="/f">재정정보공개</a><a href="/g" target="_blank">기타</a></nav><main>'),
        F.lit('<a href="https://a.org/r'), i, F.lit('">예약 '), i,
        F.lit(' 새창으로열림</a><a href="/portal/contents.do?mId=01">안내</a><a href="https://b.org/download/1">신청서</a>'
              '<p><a href="https://www.passport.go.kr/x">https://www.passport.go.kr/x</a></p><a href="https://a.org/r'), i,
        F.lit('">예약 '), i, F.lit('</a><a href="https://s.org">공유</a></main>'))
    pages = t("pages").select("page_id", "url", html.alias("html"))
    nodes = L.start_page_flags(with_nodes(pages), t("pages").where("page_id % 4 = 1"))
    nodes = S.with_main(nodes, D.first(D.select(F.col("nodes"), "main"))["pos"])
    return L.page_shortcuts(nodes).select("page_id", "n", F.col("text").alias("label"), "link_url") \
        .withColumn("n", F.col("n").cast("int"))
