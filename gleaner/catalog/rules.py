"""Text, number and predicate rules over documents, events, pages and conversations.

The fixture texts hold no labels, dates or menu words, so both sides lay the same ones into them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.functions import urls as U

_PROFILE = lx.DEFAULT_PROFILE

# -- derived texts ----------------------------------------------------------------------------

_MESSY_SQL = "replace(replace(text, ', ', ' ' || chr(160) || chr(9)), '. ', ' ' || chr(13) || chr(12288) || chr(10))"


def _messy(c):
    c = F.replace(c, F.lit(", "), F.lit(" \xa0\t"))
    return F.replace(c, F.lit(". "), F.lit(" \r　\n"))


_NOISY_SQL = ("replace(replace(text, '. ', '.' || chr(10) || '공유하기 링크' || chr(10) || '열기' || chr(10)), ', ', "
              "' 수수료 > ' || chr(10) || 'x' || chr(10))")


def _noisy(c):
    c = F.replace(c, F.lit(". "), F.lit(".\n공유하기 링크\n열기\n"))
    return F.replace(c, F.lit(", "), F.lit(" 수수료 > \nx\n"))


# -- cleaning ---------------------------------------------------------------------------------


@query(f"select doc_id, {q.clean(_MESSY_SQL)} as cleaned from documents")
def clean_text(t):
    return t("documents").select("doc_id", T.clean_text(_messy(F.col("text"))).alias("cleaned"))


@query(f"select doc_id, {q.inline(_MESSY_SQL)} as cleaned from documents")
def clean_inline(t):
    return t("documents").select("doc_id", T.clean_inline(_messy(F.col("text"))).alias("cleaned"))


@query(f"select doc_id, {q.block(_MESSY_SQL)} as cleaned from documents")
def clean_block(t):
    return t("documents").select("doc_id", T.clean_block(_messy(F.col("text"))).alias("cleaned"))


_KEPT = (f"list_filter({q.line_list(_NOISY_SQL)}, lambda l: length(l) > 1 and l not in ({q.listed(lx.NOISE_EXACT)}) "
         f"and not regexp_matches(l, '^(' || {q.words(lx.NOISE_PREFIXES)} || ')'))")
_KEPT_WASTE = f"list_filter({q.line_list(_NOISY_SQL)}, lambda l: l not in ({q.listed(lx.WASTE_NOISE_EXACT)}))"


@query(f"""select doc_id, array_to_string({_KEPT}, chr(10)) as cleaned,
  array_to_string({_KEPT_WASTE}, chr(10)) as cleaned_waste from documents""")
def noise_lines(t):
    text = _noisy(F.col("text"))
    return t("documents").select("doc_id", T.remove_noise_lines(text).alias("cleaned"),
                                 T.remove_noise_lines_waste(text).alias("cleaned_waste"))


_JUNK = (f"list_filter(list_transform(string_split({_NOISY_SQL}, chr(10)), lambda l: {q.strip('l')}), "
         f"lambda l: l <> '' and not regexp_matches(l, {q.words(lx.WASTE_JUNK)}))")


@query(f"select doc_id, array_to_string({_JUNK}, chr(10)) as cleaned from documents")
def junk_lines(t):
    return t("documents").select("doc_id", T.drop_junk_lines(_noisy(F.col("text")), lx.WASTE_JUNK).alias("cleaned"))


_PARAS = "replace(text, chr(10), chr(10) || ' ' || chr(10))"


@query(f"""with p as (select doc_id, unnest(list_filter(list_transform(
    string_split({q.clean(_PARAS)}, chr(10) || chr(10)), lambda x: {q.clean('x')}), lambda x: length(x) >= 20)) as paragraph,
  generate_subscripts(list_filter(list_transform(
    string_split({q.clean(_PARAS)}, chr(10) || chr(10)), lambda x: {q.clean('x')}), lambda x: length(x) >= 20), 1) - 1 as n
  from documents) select doc_id, n, paragraph from p""")
def paragraphs(t):
    spaced = T.clean_text(F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n")))
    return t("documents").select("doc_id", F.posexplode(T.paragraphs(spaced)).alias("n", "paragraph")).select(
        "doc_id", F.col("n").cast("long").alias("n"), "paragraph")


_KEYED = f"list_filter({q.line_list(_NOISY_SQL)}, lambda l: regexp_matches(l, {q.words(lx.KEY_LINE_WORDS)}))"


@query(f"select doc_id, len({_KEYED}) as n_lines, array_to_string({_KEYED}, chr(10)) as key_text from documents")
def key_lines(t):
    found = T.key_lines(_noisy(F.col("text")))
    return t("documents").select("doc_id", F.size(found).cast("long").alias("n_lines"),
                                 F.array_join(found, "\n").alias("key_text"))


_SQUEEZED = q.sub(_MESSY_SQL, q.WS + "+", "''")


@query(f"""select doc_id, md5({_SQUEEZED}) as squeezed, length({_SQUEEZED}) as n_squeezed,
  case when {q.strip('text')} <> '' then md5({q.strip('text')}) end as text_hash from documents""")
def text_keys(t):
    squeezed = T.squeeze(_messy(F.col("text")))
    return t("documents").select("doc_id", T.text_id(squeezed).alias("squeezed"),
                                 F.length(squeezed).cast("long").alias("n_squeezed"),
                                 T.text_hash(F.col("text")).alias("text_hash"))


_START = _PROFILE.notice_start_url


@query(f"""select page_id, md5(url) as url_id, md5({q.lit(_START)} || '#notice-' || page_id) as notice_id,
  md5('{_PROFILE.passport_source}::' || page_id || '.pdf') as file_id,
  md5(url || '|shortcut|' || page_id || '|' || url) as shortcut_id from pages""")
def doc_ids(t):
    number = F.col("page_id").cast("string")
    return t("pages").select(
        "page_id", T.text_id(F.col("url")).alias("url_id"), T.notice_id(F.lit(_START), number).alias("notice_id"),
        T.file_doc_id(_PROFILE.passport_source, F.concat(number, F.lit(".pdf"))).alias("file_id"),
        T.shortcut_id(F.col("url"), number, F.col("url")).alias("shortcut_id"))


# -- dates and numbers ------------------------------------------------------------------------

_DATED_SQL = ("case event_id % 3 when 0 then '게시 ' || year(ts) || '. ' || month(ts) || './' || day(ts) || ' 끝' "
              "when 1 then ' ' || year(ts) || '/' || month(ts) || '-' || day(ts) else '날짜  없음 ' || event_type end")
_VIEWED_SQL = "'조회 ' || (event_id // 1000) || ',' || lpad((event_id % 1000)::varchar, 3, '0') || '회'"
_DAY = r"(20[0-9]{2})[./-]" + q.WS + r"*([0-9]{1,2})[./-]" + q.WS + r"*([0-9]{1,2})"
_NORMAL = (f"case when {q.has('x', _DAY)} then {q.first_match('x', _DAY, 1)} || '-' || "
           f"lpad({q.first_match('x', _DAY, 2)}, 2, '0') || '-' || lpad({q.first_match('x', _DAY, 3)}, 2, '0') "
           f"else {q.inline('x')} end")


@query(f"""with e as (select event_id, replace({_DATED_SQL}, './', '.') as x, {_VIEWED_SQL} as v from events)
  select event_id, {_NORMAL} as day_text, try_cast({_NORMAL} as date)::varchar as day,
    try_cast(replace(regexp_extract(v, '([0-9][0-9,]*)', 1), ',', '') as bigint) as views,
    try_cast(regexp_extract(x, '(20[0-9]{{2}})', 1) as int) as year from e""")
def dates_views(t):
    y, m, d = (f("ts").cast("string") for f in (F.year, F.month, F.day))
    i = F.col("event_id")
    dated = F.when(i % 3 == 0, F.concat(F.lit("게시 "), y, F.lit(". "), m, F.lit("."), d, F.lit(" 끝"))).when(
        i % 3 == 1, F.concat(F.lit(" "), y, F.lit("/"), m, F.lit("-"), d)).otherwise(
        F.concat(F.lit("날짜  없음 "), F.col("event_type")))
    viewed = F.concat(F.lit("조회 "), F.floor(i / 1000).cast("string"), F.lit(","),
                      F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("회"))
    return t("events").select("event_id", T.normalize_date(dated).alias("day_text"), T.parse_date(dated).cast("string").alias("day"),
                              T.normalize_views(viewed).alias("views"), T.first_year(dated).alias("year"))


@query("""select doc_id, trim(regexp_replace(replace(replace(source || '_' || lang || '--' || doc_id || '.tar', '_', ' '),
  '-', ' '), '\\s+', ' ', 'g')) as title from documents""")
def filename_titles(t):
    name = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("--"), F.col("doc_id").cast("string"),
                    F.lit(".tar.pdf"))
    return t("documents").select("doc_id", T.filename_to_title(name).alias("title"))


# -- labelled fields and spans ----------------------------------------------------------------

_LABELLED_SQL = ("text || chr(10) || '담당부서 : ' || source || ' ' || lang || ' | 안내' || chr(10) || '작성일' || chr(10) || "
                 "'2024. ' || (doc_id % 12 + 1) || '. ' || (doc_id % 28 + 1) || chr(10) || '조회수：1,' || "
                 "lpad((doc_id % 1000)::varchar, 3, '0') || chr(10) || '051-123-4567' || chr(10) || '연락처 ' || n_chars")


def _labelled():
    i = F.col("doc_id")
    return F.concat(
        F.col("text"), F.lit("\n담당부서 : "), F.col("source"), F.lit(" "), F.col("lang"), F.lit(" | 안내\n작성일\n2024. "),
        (i % 12 + 1).cast("string"), F.lit(". "), (i % 28 + 1).cast("string"), F.lit("\n조회수：1,"),
        F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("\n051-123-4567\n연락처 "), F.col("n_chars").cast("string"))


@query(f"""with d as (select doc_id, source, lang, n_chars, {_LABELLED_SQL} as x from documents)
  select doc_id, {q.inline(q.first_match('x', '담당부서' + q.WS + '*[:：]?' + q.WS + '*([^\\n|]+)'))} as department,
    '2024-' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as day,
    replace({q.first_match('x', '조회수' + q.WS + '*[:：]?' + q.WS + '*([0-9,]+)')}, ',', '')::bigint as views,
    {q.first_match('x', '(0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4})')} as phone,
    source || ' ' || lang || ' | 안내' as waste_department, n_chars::varchar as contact from d""")
def labelled_fields(t):
    docs = t("documents").select("doc_id", _labelled().alias("x"))
    docs = docs.select("doc_id", T.page_metadata(F.col("x")).alias("m"), T.waste_metadata(F.col("x")).alias("w"),
                       T.notice_field(F.col("x"), ["담당자 연락처", "전화번호", "연락처"]).alias("contact"))
    return docs.select("doc_id", F.col("m.department"), F.col("m.date").alias("day"), F.col("m.views"),
                       F.col("w.phone"), F.col("w.department").alias("waste_department"), "contact")


_FORM_SQL = ("'Home 전자민원 민원사무서식 - ' || lang || ' - ' || source || ' 신고  민원분야 ' || lang || chr(10) || '담당부서 ' "
             "|| source || ' 처리기간 ' || n_chars || '일 제출처 ' || text || ' 유의사항 수수료 및 기타비용 없음 기타 끝 첨부파일 a.pdf'")


def _form():
    return F.concat(
        F.lit("Home 전자민원 민원사무서식 - "), F.col("lang"), F.lit(" - "), F.col("source"), F.lit(" 신고  민원분야 "),
        F.col("lang"), F.lit("\n담당부서 "), F.col("source"), F.lit(" 처리기간 "), F.col("n_chars").cast("string"),
        F.lit("일 제출처 "), F.col("text"), F.lit(" 유의사항 수수료 및 기타비용 없음 기타 끝 첨부파일 a.pdf"))


# "제출처" ends at "수수료 및 기타비용" (list order), although "유의사항" is nearer, and "기타" is found inside
# "기타비용", where it also ends "유의사항"
@query(f"""with d as (select doc_id, lang, source, n_chars, {q.inline('text')} as body from documents)
  select doc_id, source || ' 신고' as title, lang as category, source as department, n_chars || '일' as period,
    trim(body || ' 유의사항') as place, '수수료 및' as notes, '' as fee_rule, '없음' as fee, '비용 없음 기타 끝' as etc from (
  select doc_id, source, lang, n_chars, body from d)""")
def form_fields(t):
    docs = t("documents").select("doc_id", _form().alias("x"))
    docs = docs.select("doc_id", T.form_title(F.col("x")).alias("title"),
                       T.form_fields(T.form_body(F.col("x"))).alias("f"))
    names = {"category": "민원분야", "department": "담당부서", "period": "처리기간", "place": "제출처", "notes": "유의사항",
             "fee_rule": "행정기관의 심사기준", "fee": "수수료 및 기타비용", "etc": "기타"}
    return docs.select("doc_id", "title", *[F.col("f")[v].alias(k) for k, v in names.items()])


_NOTICE_SQL = ("'머리 1. 공고기간 앞 ' || text || ' 1. 공고대상 ' || source || chr(10) || '1. 공사개요 ' || lang || ' 1. 공사개요 ' "
               "|| text || ' 만족도조사 뒤 목록 끝'")


@query(f"""with d as (select doc_id, {_NOTICE_SQL} as x, source, lang, text from documents)
  select doc_id, {q.clean("'1. 공고대상 ' || source || chr(10) || '1. 공사개요 ' || lang || ' 1. 공사개요 ' || text || ' '", False)}
    as body, {q.strip("'1. 공사개요 ' || text || ' 만족도조사 뒤 목록 끝'")} as core from d""")
def notice_spans(t):
    x = F.concat(F.lit("머리 1. 공고기간 앞 "), F.col("text"), F.lit(" 1. 공고대상 "), F.col("source"),
                 F.lit("\n1. 공사개요 "), F.col("lang"), F.lit(" 1. 공사개요 "), F.col("text"), F.lit(" 만족도조사 뒤 목록 끝"))
    return t("documents").select("doc_id", T.notice_body(x).alias("body"), T.notice_core(x).alias("core"))


# -- predicates and scores --------------------------------------------------------------------

_PHONE, _WEB, _COLON = r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}", r"https?://|www\.", "[:：]"


def _ends(x, items):
    return f"regexp_matches({x}, '(' || {q.words(items)} || ')$')"


def is_heading(x):
    return (f"length({x}) between 2 and 30 and not {q.has(x, f'{_COLON}|{_PHONE}|{_WEB}')} and not {_ends(x, lx.SENTENCE_ENDINGS)} "
            f"and not regexp_matches({x}, {q.words(lx.HEADING_STOP_WORDS)})")


_WASTE_COLON = (f"length(lft) > 3 and not regexp_matches(rgt, {q.words(lx.WASTE_HEADING_VALUES)}) and not "
                "regexp_matches(rgt, '[0-9]') and (length(x) <= 30 or (contains(x, '수수료') and contains(x, '폐기물')))")


@query(f"""with r as (select doc_id, unnest(string_split(text, chr(10))) as l,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
  v as (select doc_id, line_no, {q.inline('''case (line_no + doc_id) % 8 when 7 then l when 0 then l || '안내'
    when 1 then l || ' 방법' when 2 then l || ': 문의 1' when 3 then l || '합니다'
    when 4 then l || '?' when 5 then '※ ' || l else l || ' 3개월' end''')} as x from r),
  w as (select *, {q.strip(q.first_match('x', '^([^:：]*)[:：]'))} as lft,
    {q.strip(q.first_match('x', '^[^:：]*[:：](.*)'))} as rgt from v)
  select doc_id, line_no,
    {is_heading('x')} as heading,
    case when length(x) not between 2 and 50 then false
      when {q.has('x', f'{_WEB}|{_PHONE}')} or {q.has('x', '^(※|-|·|ㆍ)')} or {_ends('x', lx.SENTENCE_ENDINGS)} then false
      when x in ({q.listed(lx.WASTE_HEADING_EXACT)}) then true
      when {q.has('x', _COLON)} then {_WASTE_COLON}
      when {_ends('x', lx.WASTE_HEADING_ENDINGS)} or x like '%?' then true
      else len(string_split(x, ' ')) <= 5 and length(x) <= 30 end as waste_heading,
    case when length(x) not between 1 and 50 then false
      when {q.has('x', f'{_WEB}|{_PHONE}')} or {q.has('x', '^(※|-|·|ㆍ)')} then false
      when regexp_matches(x, {q.words(lx.LIST_HEADING_WORDS)}) and length(x) > 25 then false
      when {_ends('x', lx.LIST_HEADING_ENDINGS)} then true else length(x) <= 20 end as list_heading,
    {q.has('x', f"{_COLON}|{_PHONE}|{_WEB}|[0-9]+ *(" + '|'.join(lx.COUNTED_UNITS) + ")")} as data_line,
    x = '' or x in ({q.listed(_PROFILE.noise_headings)}) as noise_heading,
    x not in ({q.listed(_PROFILE.noise_headings)})
      and not {q.has('x', f"{_COLON}|{_PHONE}|{_WEB}|[0-9]+ *(" + '|'.join(lx.COUNTED_UNITS) + ")")}
      and length(x) between 2 and 35 and not {_ends('x', lx.SENTENCE_ENDINGS)}
      and not regexp_matches(' ' || x || ' ', {q.words(lx.REAL_HEADING_BAD_WORDS)}) as real_heading from w""")
def heading_rules(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    shape, line = F.pmod(F.col("line_no") + F.col("doc_id"), F.lit(8)), F.col("l")
    x = (
        F.when(shape == 7, line).when(shape == 0, F.concat(line, F.lit("안내"))).when(shape == 1, F.concat(line, F.lit(" 방법")))
        .when(shape == 2, F.concat(line, F.lit(": 문의 1"))).when(shape == 3, F.concat(line, F.lit("합니다")))
        .when(shape == 4, F.concat(line, F.lit("?"))).when(shape == 5, F.concat(F.lit("※ "), line))
        .otherwise(F.concat(line, F.lit(" 3개월")))
    )
    rows = rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), x.alias("x"))
    x = F.col("x")
    return rows.select("doc_id", "line_no", P.looks_like_heading(x).alias("heading"),
                       P.looks_like_waste_heading(x).alias("waste_heading"), P.is_list_heading(x).alias("list_heading"),
                       P.is_data_line(x).alias("data_line"), P.is_noise_heading(x).alias("noise_heading"),
                       P.is_real_heading(x).alias("real_heading"))


_TITLED = "case doc_id % 5 when 0 then '메뉴' when 1 then '폐 기물' when 2 then text || '.pdf' else source end"


@query(f"""with d as (select doc_id, {q.strip(_TITLED)} as x, {q.inline(_TITLED)} as y, source from documents)
  select doc_id, x = '' or x in ({q.listed(lx.BAD_TITLES)}) or contains(x, {q.lit(_PROFILE.english_name)}) as bad_title,
    y = '' or y in ({q.listed(lx.BAD_HEADINGS)}) or {q.sub('y', q.WS + '+', "''")} = '폐기물' as bad_heading,
    y = '' or contains(y, '다운로드') or {q.has('y', '[.](hwp|pdf|xlsx|xls)$')} or y in ('다운로드', '보기', '첨부파일') as bad_table,
    md5({q.sub('y', q.WS + '+', "''")}) as normal_heading from d""")
def title_rules(t):
    i = F.col("doc_id") % 5
    x = F.when(i == 0, F.lit("메뉴")).when(i == 1, F.lit("폐 기물")).when(i == 2, F.concat("text", F.lit(".pdf"))) \
        .otherwise(F.col("source"))
    return t("documents").select("doc_id", P.is_bad_title(x).alias("bad_title"),
                                 P.is_bad_heading(x, F.lit("폐기물")).alias("bad_heading"),
                                 P.is_bad_table_title(x).alias("bad_table"),
                                 T.text_id(T.normalize_heading(x)).alias("normal_heading"))


_SIGNALLED = ("text || case doc_id % 4 when 0 then chr(10) || '주메뉴 공유 저작권' when 1 then chr(10) || '수수료 문의처' else '' end")
_MENU_LIKE = (f"(len({q.line_list('x')}) = 0 or {q.count_words('x', _PROFILE.menu_signals)} >= 3 or "
              f"len(list_filter({q.line_list('x')}, lambda l: length(l) <= 12)) > len({q.line_list('x')}) * 0.70)")


@query(f"""with d as (select doc_id, {_SIGNALLED} as x from documents)
  select doc_id, {_MENU_LIKE} as menu_like, {q.count_words('x', _PROFILE.menu_signals)} as n_signals,
    {q.count_words('x', lx.SECTION_HINTS)} * 2 + least(length(x) // 250, 8)
      - {q.count_words('x', _PROFILE.menu_signals)} * 2 as node_score,
    2 + 1 + (length(x) >= 200)::int * 2 + (length(x) >= 500)::int * 2 + 3
      + regexp_matches(x, {q.words(lx.SECTION_HINTS)})::int * 3 - ({_MENU_LIKE})::int * 5 as doc_score from d""")
def document_scores(t):
    i = F.col("doc_id") % 4
    x = F.concat("text", F.when(i == 0, "\n주메뉴 공유 저작권").when(i == 1, "\n수수료 문의처").otherwise(""))
    docs = t("documents").select("doc_id", x.alias("x"))
    x = F.col("x")
    return docs.select("doc_id", P.is_menu_like(x).alias("menu_like"),
                       T.count_contained(x, _PROFILE.menu_signals).alias("n_signals"),
                       P.node_score(x).alias("node_score"),
                       P.document_score(F.lit("https://a.kr/portal/contents.do"), F.lit("제목"), x, F.lit(3)
                                        ).alias("doc_score"))


@query(f"""with r as (select doc_id, unnest(string_split(text, chr(10))) as l,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
  select doc_id, line_no, length({q.strip('l')}) >= 15 and not contains(l, 'research_box')
    and length({q.strip('l')}) - length(replace({q.strip('l')}, '|', '')) < 3 as passes,
    length(l) >= 80 as long_enough from r""")
def section_gate(t):
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "l"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"),
                       P.passes_section_gate(F.col("l"), F.lit("paragraph")).alias("passes"),
                       P.long_enough(F.col("l"), 80).alias("long_enough"))


@query(f"""select doc_id, regexp_matches(source || ' ' || case doc_id % 3 when 0 then '전입 신고' else lang end || '   ' || text,
  {q.words(lx.FORM_TARGET_WORDS)}) as target from documents""")
def target_forms(t):
    category = F.when(F.col("doc_id") % 3 == 0, "전입 신고").otherwise(F.col("lang"))
    return t("documents").select("doc_id", P.is_target_form(F.col("source"), category, F.lit(None), F.lit(None),
                                                           F.col("text")).alias("target"))


@query("""select event_id, cast(ts as date) >= date '2024-01-15' - 5 as recent,
  coalesce(year(ts) - event_id % 8 between 2020 and 2024, true) as recent_label,
  year(ts) - event_id % 8 >= 2021 as recent_form,
  lower(event_type) <> 'view' as html from events""")
def recency_rules(t):
    label = F.concat(F.lit("제45회 ("), (F.year("ts") - F.col("event_id") % 8).cast("string"), F.lit(")"))
    written = F.concat((F.year("ts") - F.col("event_id") % 8).cast("string"), F.lit("-01-02 작성"))
    kind = F.when(F.col("event_type") == "view", "application/pdf").when(F.col("event_type") == "click", "") \
        .otherwise("Text/HTML; charset=utf-8")
    return t("events").select(
        "event_id", P.is_recent_date(F.date_format("ts", "yyyy.M.d"), "2024-01-15", 5).alias("recent"),
        P.is_recent_year_label(label, 2024).alias("recent_label"),
        P.mentions_recent_year(written).alias("recent_form"), P.is_html(kind).alias("html"))


# -- display and file names -------------------------------------------------------------------


@query("""select doc_id, replace(replace('<b>' || text || '</b>', '<', '&lt;'), '>', '&gt;') as safe from documents""")
def escaped_text(t):
    return t("documents").select("doc_id", T.escape_html(F.concat(F.lit("<b>"), "text", F.lit("</b>"))).alias("safe"))


@query(f"""select doc_id, source || '_' || doc_id || '.HWP' as name, 'hwp' as extension,
  {q.lit(_PROFILE.file_down_url)} || '?atchFileId=FILE_' || doc_id || '&fileSn=' || (doc_id % 3) as url,
  case doc_id % 4 when 0 then 'https://x.kr/' || doc_id when 1 then {q.lit(_PROFILE.notice_base_url)} || '/emwp/f/' || doc_id
    when 2 then {q.lit(_PROFILE.notice_action_url.rsplit('/', 2)[0])} || '/' || doc_id else '' end as notice_url
  from documents""")
def attachment_names(t):
    i = F.col("doc_id").cast("string")
    around = F.concat(F.lit("서식 "), "source", F.lit("_"), i, F.lit(".HWP [49.0 KByte] 다운로드"))
    name = T.attachment_name(F.lit(""), F.lit("다운로드"), F.lit("다운로드"), around)
    call = F.concat(F.lit("fn_egov_downFile('FILE_"), i, F.lit("' , '"), (F.col("doc_id") % 3).cast("string"), F.lit("')"))
    href = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("https://x.kr/"), i)) \
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("/emwp/f/"), i)) \
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("../"), i)).otherwise("javascript:f()")
    return t("documents").select(
        "doc_id", name.alias("name"), T.file_extension(name).alias("extension"),
        T.download_url(*T.download_ids(call)).alias("url"), U.notice_file_url(href).alias("notice_url"))
