"""Table and document jobs over pages that hold rows of the relational tables.

The page snapshot has no tables or forms, so each row of ``part``, ``supplier``, ``customer`` or ``orders``
is laid out as one page, and the counterpart states the expected sections straight from the row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.functions import dom as D
from gleaner.operators import links as L
from gleaner.operators import sections as S
from gleaner.plans import documents as P
from gleaner.sources.pages import with_nodes

_PROFILE = lx.DEFAULT_PROFILE


def _html(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _text(name):
    return F.col(name).cast("string")


def _waste(pages):
    """Waste sections of (page_id, html) rows whose content node is the body."""
    nodes = with_nodes(pages.withColumn("topic", F.lit("주제")), lx.WASTE_NOISE_SELECTORS)
    nodes = S.with_main(nodes, D.first(D.select(F.col("nodes"), "body"))["pos"])
    found = S.waste_sections(nodes)
    return found.select("page_id", "section_pos", "sub", F.array_join("heading_path", " > ").alias("path"), "block_type", "text")


def _table(pages):
    return _waste(pages).select("page_id", "path", "block_type", "text")


@query("""select p_partkey as page_id, '주제 > ' || p_type || ' > ' || p_name as path, 'table_row' as block_type,
  '품명: ' || p_name || chr(10) || '규격: ' || p_brand || chr(10) || '수수료 계: ' || p_size || chr(10) || '수집·운반비: 1' || chr(10)
  || '처리비: 2' as text from part
  union all select p_partkey, '주제 > ' || p_type || ' > ' || p_name, 'table_row', '품명: ' || p_name || chr(10) || '규격: 큰 것' || chr(10)
  || '수수료 계: 9' || chr(10) || '수집·운반비: ' || chr(10) || '처리비: 3' from part""")
def fee_tables(t):
    """Row spans carry the type, number and name of an item into its second row."""
    html = _html(
        '<body><table><caption>대형폐기물 수집 및 운반 처리 수수료</caption><tbody><tr><td rowspan="2">', _text("p_type"),
        '</td><td rowspan=2>1</td><td rowspan="2">', _text("p_name"), '</td><td>1</td><td>', _text("p_brand"), '</td><td>',
        _text("p_size"), '</td><td>1</td><td>2</td></tr><tr><td>2</td><td>큰  것</td><td>9</td><td></td><td>3</td></tr>'
        '<tr><td colspan="7">합계</td></tr></tbody></table></body>')
    return _table(t("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""select p_partkey as page_id, '주제 > 배출요령 > ' || p_name as path, 'table_row' as block_type, p_brand || chr(10) || p_type
    as text from part
  union all select p_partkey, '주제 > 음식물 전용용기에 넣어서는 안되는 물질', 'table_row', 'x' || p_size from part""")
def item_guide_tables(t):
    html = _html(
        "<body><table><tr><th>품목</th><th>배출요령</th><th>금지</th></tr><tbody><tr><td>", _text("p_name"), "</td><td>",
        _text("p_brand"), "<br>", _text("p_type"), "</td><td>x", _text("p_size"),
        "</td></tr><tr><td>둘</td><td></td><td></td></tr></tbody></table></body>")
    return _table(t("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""select s_suppkey as page_id, '주제 > 표 제목 > 쓰레기 배출요일 > ' || d.day as path, 'table_row' as block_type,
  case d.day when '월' then s_name else 'n' || s_nationkey end as text from supplier, (values ('월'), ('수')) d(day)""")
def weekday_tables(t):
    """A table inside a list item takes the item's own text as its path."""
    html = _html(
        "<body><ul><li>표 제목<table><caption>쓰레기 배출요일 안내</caption><thead><tr><th>요일</th><th>월</th><th>화</th><th>수</th></tr>"
        "</thead><tbody><tr><td>종류</td><td>", _text("s_name"), "</td><td></td><td>n", _text("s_nationkey"),
        "</td></tr></tbody></table></li></ul></body>")
    return _table(t("supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")))


@query("""select s_suppkey as page_id, '주제 > ' || s_name as path, 'table_row' as block_type,
  '담당구역: N' || s_nationkey || chr(10) || '전화번호: 051-' || s_suppkey as text from supplier""")
def company_tables(t):
    html = _html(
        "<body><table><caption>생활폐기물 수집 및 운반업체</caption><tbody><tr><td>", _text("s_name"), "</td><td> N",
        _text("s_nationkey"), " </td><td>051-", _text("s_suppkey"), "</td></tr><tr><td>짧은</td></tr></tbody></table></body>")
    return _table(t("supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")))


@query("""select p_partkey as page_id, '주제 > ' || p_type || ' > 3L' as path, 'table_column' as block_type,
  '가격: ' || p_size || chr(10) || '용도: 가' as text from part
  union all select p_partkey, '주제 > 음식', 'table_column', '가격: ' || (p_size + 1) from part""")
def price_tables(t):
    html = _html(
        "<body><table><caption>규격봉투 가격표</caption><tr><th>구분</th><th>", _text("p_type"), "</th><th>음식</th></tr><tr><td>가격</td><td>0</td></tr>"
        "<tr><td>용기규격</td><td>3L</td></tr><tr><td>가격</td><td>", _text("p_size"), "</td><td>",
        (F.col("p_size") + 1).cast("string"), "</td></tr><tr><td>용도</td><td>가</td></tr></table></body>")
    return _table(t("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("""select c_custkey as page_id, '주제 > ' || c_mktsegment || ' > 갑' as path, 'table_row' as block_type, c_name || ' 둘' as text
    from customer
  union all select c_custkey, '주제 > ' || c_mktsegment || ' > 을', 'table_row', 'n' || c_nationkey from customer
  union all select c_custkey, '주제 > 키', 'table_row', 'k' || c_custkey from customer""")
def general_tables(t):
    html = _html(
        "<body><table><tr><th colspan=2>분 류</th><th>품명</th></tr><tr><td rowspan=2>", _text("c_mktsegment"), "</td><td>갑</td><td>",
        _text("c_name"), "</td><td>둘</td></tr><tr><td>을</td><td>n ", _text("c_nationkey"), "</td></tr><tr><td>키</td><td>k",
        _text("c_custkey"), "</td></tr></table></body>")
    return _table(t("customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")))


@query("""select c_custkey as page_id, '주제 > 배출 안내' as path, 'list' as block_type, '첫째 ' || c_name || chr(10) || '둘째' as text from customer
  union all select c_custkey, '주제 > 배출 안내 > ' || c_mktsegment || ' 처리', 'list', '가' || c_custkey || chr(10) || '나' from customer
  union all select c_custkey, '주제 > 배출 안내 > ' || c_mktsegment || ' 처리', 'paragraph', '여기를 보시기 바랍니다' || chr(10) || c_name from customer
  union all select c_custkey, '주제 > 다음 기준', 'paragraph', '설명은 ' || c_custkey || '번 창구에서 합니다' from customer
  union all select c_custkey, '주제 > 다음 기준', 'definition_list', '용어: 1' || chr(10) || '뜻은 있습니다' from customer""")
def waste_outline(t):
    """Headings, nested lists, paragraphs and a definition list of waste guide pages."""
    html = _html(
        "<body><h1>폐기물</h1><h2>배출 안내</h2><ul><li>첫째 ", _text("c_name"), "</li><li>둘째</li><li>", _text("c_mktsegment"),
        " 처리<ul><li>가", _text("c_custkey"), "</li><li>나</li></ul></li></ul><p>여기를 보시기 바랍니다<br>", _text("c_name"),
        "</p><h2>다음 기준</h2><p>설명은 ", _text("c_custkey"), "번 창구에서 합니다</p><p>설명은 ", _text("c_custkey"),
        "번 창구에서 합니다</p><dl>용어: 1<dd>뜻은 있습니다</dd></dl></body>")
    return _table(t("customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")))


# -- whole documents --------------------------------------------------------------------------

_URL = "https://www.portal.example.kr/portal/contents.do?mId=0103010000&c="


def _general_pages(t):
    html = _html(
        "<html><head><title>", _text("c_name"), " 안내 상세 | 누리집</title></head><body><nav>메뉴 줄</nav><div id=contents>앞말<h2>신청 안내</h2>"
        "신청대상은 ", _text("c_mktsegment"), " 주민이며 방문하여 신청하시면 됩니다<h3>", _text("c_name"),
        "</h3>수수료는 없으며 처리기간은 삼 일입니다 자세한 내용은 아래 표를 보시기 바랍니다<table><thead><tr><th>구분</th><th>값</th></tr></thead><tr><td>키</td><td>",
        _text("c_custkey"), "</td></tr></table><ul><li>하나 ", _text("c_nationkey"), "</li><li>둘째 줄</li></ul><p><a href='https://a.org/",
        _text("c_custkey"), "'>예약 창구</a></p></div><p>담당부서: ", _text("c_mktsegment"), "과 작성일: 2024.1.5 조회수 1,",
        F.lpad(F.pmod("c_custkey", F.lit(1000)).cast("string"), 3, "0"), "</p></body></html>")
    return t("customer").select(
        F.col("c_custkey").alias("page_id"), F.concat(F.lit(_URL), _text("c_custkey")).alias("url"), html.alias("html"),
        F.lit("").alias("parent_url"), F.col("c_name").alias("anchor_text"), F.array(F.lit("전자민원")).alias("menu_path"))


_N = "chr(10)"
_INTRO = "'신청대상은 ' || c_mktsegment || ' 주민이며 방문하여 신청하시면 됩니다'"
_FEES = "'수수료는 없으며 처리기간은 삼 일입니다 자세한 내용은 아래 표를 보시기 바랍니다'"
_GENERAL_TEXT = " || ".join(
    x if i == 0 else f"chr(10) || {x}" for i, x in enumerate([
        "'제목: ' || c_name || ' 안내'", "'메뉴경로: 전자민원'", "'[섹션 구조]'", "'전체 본문'", "'[전체 본문]'", "'앞말'", "'신청 안내'", _INTRO,
        "c_name", _FEES, "'구분'", "'키' || chr(10) || c_custkey", "'하나 ' || c_nationkey", "'둘째 줄'", "'예약 창구'",
        "'신청 안내'", "'신청 안내'", _INTRO, "'신청 안내 > ' || c_name", "c_name", _FEES, "'[표]'", "'구분: 구분 | 값: 값'",
        "'구분: 키 | 값: ' || c_custkey", "'[목록]'", "'하나 ' || c_nationkey", "'둘째 줄'", "'예약 창구'",
        "'[바로가기 링크]'", "'- 예약 창구: https://a.org/' || c_custkey"]))


@query(f"""with d as (select *, array_to_string(list_filter(string_split({_GENERAL_TEXT}, chr(10)), lambda l: length(l) > 1), chr(10)) as x from customer)
  select c_custkey as page_id, md5({q.lit(_URL)} || c_custkey) as doc_id, c_name || ' 안내' as title, '전자민원' as top_menu,
    'contents' as page_type, c_mktsegment || '과 작성일: 2024.1.5 조회수 1,' || lpad((c_custkey % 1000)::varchar, 3, '0') as department,
    '2024-01-05' as day, 1000 + c_custkey % 1000 as views, 6 as n_sections, 1 as n_links, x as text,
    2 + 1 + (length(x) >= 200)::int * 2 + (length(x) >= 500)::int * 2 + 5 + 3
      - (len(list_filter(string_split(x, chr(10)), lambda l: length(l) <= 12)) > len(string_split(x, chr(10))) * 0.70)::int * 5 as score
  from d""")
def general_documents(t):
    docs = P.general_documents(_general_pages(t))
    return docs.select("page_id", "doc_id", "title", "top_menu", "page_type", "department", F.col("date").alias("day"), "views",
                       F.size("sections").alias("n_sections"), F.size("shortcut_links").alias("n_links"), "text", "score")


@query("""select c_custkey as page_id, c_mktsegment as title, '수납 ' || c_custkey as category, c_name as department,
  '즉시 ' || c_nationkey || '일' as processing_period, '' as fee, 'a' || c_custkey || '.hwp' as file,
  '제목: ' || c_mktsegment || chr(10) || '민원분야: 수납 ' || c_custkey || chr(10) || '담당부서: ' || c_name || chr(10) || '처리기간: 즉시 '
    || c_nationkey || '일' || chr(10) || '첨부파일: a' || c_custkey || '.hwp' as text from customer""")
def form_documents(t):
    html = _html(
        "<body><nav>민원분야 메뉴</nav><div class='contents'>Home 민원사무서식 - 분류 - ", _text("c_mktsegment"), " <dl><dt>민원분야</dt><dd>수납 ",
        _text("c_custkey"), "</dd><dt>담당부서</dt><dd>", _text("c_name"), "</dd><dt>처리기간</dt><dd>즉시  ", _text("c_nationkey"),
        "일</dd></dl>첨부파일 <a href='#' onclick=\"fn_egov_downFile('F", _text("c_custkey"), "','1')\">a", _text("c_custkey"),
        ".hwp [12.5 KByte]</a></div></body>")
    pages = t("customer").select(F.col("c_custkey").alias("page_id"), F.lit("https://www.portal.example.kr/portal/civil/view.do").alias("url"),
                                 html.alias("html"))
    docs = P.form_documents(pages)
    return docs.select("page_id", "title", "category", "department", "processing_period", "fee",
                       F.get("attachments", F.lit(0))["filename"].alias("file"), "text")


@query(f"""with d as (select *, '공고 ' || o_orderkey as title, '제' || o_custkey || '호' as no from orders)
  select o_orderkey as page_id, md5({q.lit(_PROFILE.notice_start_url)} || '#notice-' || o_orderkey) as doc_id, title, no as notice_no,
    '입찰' as notice_type, strftime(o_orderdate, '%Y-%m-%d') as day, '재무과' as department, '051-1' as phone,
    '1. 공고대상' || chr(10) || o_orderpriority as body, 'f' || o_orderkey || '.pdf' as file,
    {q.lit(_PROFILE.notice_base_url)} || '/emwp/' || o_orderkey as file_url from d""")
def notice_documents(t):
    html = _html(
        "<body><script>제목 x</script><table><tr><th>제목</th><td>공고 ", _text("o_orderkey"), "</td></tr><tr><th>고시공고구분</th><td>입찰</td></tr>"
        "<tr><th>고시공고번호 :</th><td>제", _text("o_custkey"), "호</td></tr><tr><th>작성일</th><td>", F.date_format("o_orderdate", "yyyy-MM-dd"),
        "</td></tr><tr><th>연락처</th><td>051-1</td></tr></table><a href='/emwp/", _text("o_orderkey"), "'>f", _text("o_orderkey"),
        ".pdf</a><a href='javascript:x()'>s.hwp</a><p>1. 공고대상<br>", _text("o_orderpriority"), "</p><a href='#'>목록</a>뒤</body>")
    pages = t("orders").select(F.col("o_orderkey").alias("page_id"), _text("o_orderkey").alias("notice_id"), html.alias("html"))
    docs = P.notice_documents(pages)
    first = F.get("attachments", F.lit(0))
    return docs.select("page_id", "doc_id", "title", "notice_no", "notice_type", F.col("date").alias("day"), "department", "phone",
                       "body", first["file_name"].alias("file"), first["file_url"].alias("file_url"))


@query("""select c_custkey as page_id, c_name as title, '0405050000' as "mId", c_mktsegment || '팀' as department, '051-123-4567' as phone,
  '2024-1-5' as day, '7' as views, 2 as n_key_lines,
  '제목: ' || c_name || chr(10) || chr(10) || '메뉴경로: 분야별정보 > 환경/청소 > 폐기물 > 생활 > 수거' || chr(10) || chr(10) || '분류: 생활'
    || chr(10) || chr(10) || '주제: 수거' || chr(10) || chr(10) || '[섹션 구조]' || chr(10) || chr(10) || '[SECTION] 수거 > 배출 요령' || chr(10) || chr(10)
    || '쓰레기는 ' || c_mktsegment || ' 봉투에 담아 집 앞에 두시고 저녁 여덟 시 이후에 내놓으시기 바랍니다' as text from customer""")
def waste_documents(t):
    html = _html(
        "<head><title>", _text("c_name"), " | 누리집</title></head><body><div id=conts><h2>배출 요령</h2><p>쓰레기는 ", _text("c_mktsegment"),
        " 봉투에 담아 집 앞에 두시고 저녁 여덟 시 이후에 내놓으시기 바랍니다</p></div><footer>담당부서 ", _text("c_mktsegment"),
        "팀<br>전화 051-123-4567<br>최종수정일: 2024.1.5<br>조회수 7</footer></body>")
    pages = t("customer").select(
        F.col("c_custkey").alias("page_id"), F.lit(_PROFILE.waste_parent_url).alias("url"), html.alias("html"),
        F.lit("생활").alias("category"), F.lit("수거").alias("topic"))
    docs = P.waste_documents(pages)
    return docs.select("page_id", "title", "mId", "department", "phone", F.col("date").alias("day"), "views",
                       F.size("key_sections").alias("n_key_lines"), "text")


@query(f"""select p_partkey as page_id, md5('{_PROFILE.passport_source}::' || p_name || '.pdf') as doc_id, p_name as title,
  {q.strip('''('제목: ' || p_name || chr(10) || '메뉴경로: 외교부 여권안내 > 여권기본사항 > 신청서식 모음' || chr(10) || '출처페이지: ' || '''
           + q.lit(_PROFILE.passport_url) + ''' || chr(10) || chr(10) || '[서식 정보]' || chr(10) || '서식명: ' || p_name || chr(10)
  || '파일명: ' || p_name || '.pdf' || chr(10) || chr(10) || '[PDF 본문]' || chr(10) || p_type || ' ' || chr(10) || chr(10) || p_brand)''')} as text,
  9 as n_lines from part""")
def passport_documents(t):
    from gleaner.functions import text as T

    name = F.concat(F.col("p_name"), F.lit(".pdf"))
    files = t("part").select(
        T.file_doc_id(_PROFILE.passport_source, name).alias("doc_id"),
        name.alias("file_name"), T.filename_to_title(name).alias("title"), _text("p_partkey").alias("file_path"),
        F.concat(F.col("p_type"), F.lit("  \n \n\n"), F.col("p_brand"), F.lit("\xa0 ")).alias("pdf_text"))
    docs = P.passport_documents(files)
    return docs.select(F.col("attachments")[0]["url"].cast("long").alias("page_id"), "doc_id", "title", "text",
                       F.size("paragraphs").alias("n_lines"))


# -- board listings ---------------------------------------------------------------------------


@query("""select o_orderkey as page_id, 1 as row_no, o_orderkey::varchar as number, '제목 ' || o_orderstatus as title,
  case when year(o_orderdate) >= 2000 then o_orderpriority else '' end as department,
  case when year(o_orderdate) >= 2000 then strftime(o_orderdate, '%Y-%m-%d') else '' end as day, o_custkey as views,
  'https://www.portal.example.kr/portal/bbs/view.do?id=' || o_orderkey as url from orders""")
def board_rows(t):
    """Every order as a listing row; the date rule knows years from 2000 on, so older rows have no date and department."""
    html = _html(
        "<table><tr><th>번호</th><th>제목</th><th>부서</th><th>작성일</th><th>조회</th></tr><tr><td>", _text("o_orderkey"), "</td><td><a href='view.do?id=",
        _text("o_orderkey"), "#x'>제목 ", _text("o_orderstatus"), "</a></td><td>", _text("o_orderpriority"), "</td><td>",
        F.date_format("o_orderdate", "yyyy.MM.dd"), "</td><td>", _text("o_custkey"), "</td></tr><tr><td>짧은</td><td>행</td></tr></table>")
    pages = t("orders").select(
        F.col("o_orderkey").alias("page_id"), F.lit("https://www.portal.example.kr/portal/bbs/list.do?mId=0301").alias("url"), html.alias("html"))
    rows = L.board_rows(with_nodes(pages))
    return rows.select("page_id", F.col("row_no").cast("int").alias("row_no"), "number", "title", "department", F.col("date").alias("day"),
                       "views", "url")
