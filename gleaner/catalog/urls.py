"""Url rules over page urls and the links in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.catalog import query
from gleaner.catalog import sqltext as q
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.functions import urls as U

_PROFILE = lx.DEFAULT_PROFILE
_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""select page_id, {_HOST} as host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path,
  regexp_extract(url, '[?&]page=([^&#]+)', 1) as page_no,
  regexp_extract(url, '[?&]utm_source=([^&#]+)', 1) as utm_source from pages""")
def url_parts(t):
    url = F.col("url")
    return t("pages").select("page_id", U.host(url).alias("host"), U.path(url).alias("path"),
                             U.query_param(url, "page").alias("page_no"),
                             U.query_param(url, "utm_source").alias("utm_source"))


# portal urls made of page ids: the fixture has no portal pages
_PATHS = ["contents.do", "bbs/list.do", "bbs/view.do", "civil/view.do", "login.do", "other.do"]
_PORTAL_SQL = ("case page_id % 7 when 6 then url else 'https://www.portal.example.kr/portal/' || "
               f"([{q.listed(_PATHS)}])[(page_id % 6 + 1)::int] || '?x=1&mId=' || lpad((page_id % 9)::varchar, 2, '0') || "
               "lpad((page_id % 11)::varchar, 2, '0') || '000000#top' end")


def _portal():
    i = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (i % 6 + 1).cast("int"))
    made = F.concat(F.lit("https://www.portal.example.kr/portal/"), kind, F.lit("?x=1&mId="),
                    F.lpad((i % 9).cast("string"), 2, "0"), F.lpad((i % 11).cast("string"), 2, "0"), F.lit("000000#top"))
    return F.when(i % 7 == 6, F.col("url")).otherwise(made)


_MID = "regexp_extract(u, '[?&]mId=([^&#]+)', 1)"
_MENU_OK = (f"left({_MID}, 2) in ({q.listed(_PROFILE.top_menus)}) and not "
            f"regexp_matches({_MID}, '^({'|'.join(lx.EXCLUDED_MENU_PREFIXES)})')")
_KIND = ("case " + " ".join(f"when contains(lower(u), {q.lit(w)}) then {q.lit(k)}" for w, k in lx.PAGE_TYPES)
         + " else 'other' end")
_ON_HOST = f"regexp_extract(u, '^https?://([^/?#]*)', 1) in ({q.listed(_PROFILE.hosts)})"


@query(f"""with p as (select page_id, {_PORTAL_SQL} as u from pages)
  select page_id, {_MID} as menu_id, {_KIND} as page_type,
    coalesce(case left({_MID}, 2) {' '.join(f"when {q.lit(k)} then {q.lit(v)}" for k, v in _PROFILE.top_menus.items())} end,
      '기타') as top_menu,
    {_MENU_OK} as allowed_menu, {_ON_HOST} and contains(u, '/portal/') as portal,
    not regexp_matches(lower(u), {q.words(lx.DENY_URL_WORDS)}) and {_ON_HOST} and contains(u, '/portal/')
      and regexp_matches(lower(u), {q.words(lx.ALLOWED_PATHS)}) and {_MENU_OK} as allowed,
    {_KIND} in ({q.listed(lx.SAVED_PAGE_TYPES)}) and {_MENU_OK} as savable from p""")
def url_gate(t):
    u = F.col("u")
    pages = t("pages").select("page_id", _portal().alias("u"))
    return pages.select(
        "page_id", U.menu_id(u).alias("menu_id"), U.page_type(u).alias("page_type"),
        U.top_menu(u, _PROFILE.top_menus).alias("top_menu"), P.has_allowed_menu(u).alias("allowed_menu"),
        P.is_portal_url(u).alias("portal"), P.is_allowed_url(u).alias("allowed"),
        P.should_save(u, F.lit("메뉴")).alias("savable"))


_REFS = ["/a/../b?x=1#f", "c/./d", "?p=2", "#frag", "//h.org/x", "http://o.org/y#z", "mailto:a@b"]
_ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_FOLDER = "regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"


@query(f"""with p as (select page_id, url, unnest(range(7)) as n from pages)
  select page_id, n, case n when 0 then {_ROOT} || '/b?x=1' when 1 then {_ROOT} || {_FOLDER} || 'c/d'
    when 2 then regexp_extract(url, '^([^?#]*)', 1) || '?p=2' when 3 then regexp_extract(url, '^([^#]*)', 1)
    when 4 then regexp_extract(url, '^(https?:)', 1) || '//h.org/x' when 5 then 'http://o.org/y'
    else 'mailto:a@b' end as link, case when n < 4 and {_HOST} = 'm.ththth.example.net' or n = 4 and false
      then case n when 0 then {_ROOT} || '/b?x=1' when 1 then {_ROOT} || {_FOLDER} || 'c/d'
        when 2 then regexp_extract(url, '^([^?#]*)', 1) || '?p=2' else regexp_extract(url, '^([^#]*)', 1) end
      end as kept_link from p""")
def resolved_links(t):
    refs = F.array(*[F.lit(r) for r in _REFS])
    rows = t("pages").select("page_id", "url", F.posexplode(refs).alias("n", "href"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), U.resolve(F.col("url"), F.col("href")).alias("link"),
                       U.normalize_url(F.col("url"), F.col("href"), ["m.ththth.example.net"]).alias("kept_link"))


@query("""with p as (select page_id, url, unnest(range(1, 4)) as n from pages)
  select page_id, n, case when n = 1 then url when contains(url, '?') then url || '&page=' || n
    else url || '?page=' || n end as link from p""")
def listing_urls(t):
    rows = t("pages").select("page_id", F.posexplode(U.listing_urls(F.col("url"), 3)).alias("i", "link"))
    return rows.select("page_id", (F.col("i") + 1).cast("long").alias("n"), "link")


_LABELS = ["신청 안내", "바로가기", "공유", "누리집", "정부24"]
_LABEL = f"([{q.listed(_LABELS)}])[(page_id % 5 + 1)::int]"


@query(f"""with p as (select page_id, url, {_LABEL} as label, {_HOST} not in ({q.listed(_PROFILE.hosts)}) as away from pages)
  select page_id, not regexp_matches(label, {q.words(lx.SHORTCUT_DENY)}) and label not in ({q.listed(lx.SHORTCUT_GENERIC)})
      and (regexp_matches(label, {q.words(lx.SHORTCUT_ALLOW)}) or away) as valid,
    not regexp_matches(label, {q.words(lx.SHORTCUT_DENY)}) and label not in ({q.listed(lx.SHORTCUT_GENERIC)})
      and (regexp_matches(label, {q.words(lx.SHORTCUT_ALLOW)}) or away) as shortcut_only,
    regexp_matches(label, {q.words(lx.SHORTCUT_LABELS)}) as labelled from p""")
def shortcut_rules(t):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("page_id") % 5 + 1).cast("int"))
    return t("pages").select(
        "page_id", P.is_valid_shortcut(label, F.col("url"), F.col("url")).alias("valid"),
        P.is_shortcut_only(label, F.col("url")).alias("shortcut_only"), P.is_shortcut_label(label).alias("labelled"))


_PAGE_TYPE = "(source || case doc_id % 4 when 0 then '서식' when 1 then ' 안내' when 2 then 'civil' else '소식' end)"


@query(f"""select doc_id, regexp_matches({_PAGE_TYPE}, {q.words(lx.ATTACHMENT_PAGE_WORDS)}) as offers, doc_id % 3 <> 2 as own_link,
  case when doc_id % 3 = 0 then '/download/' || doc_id || 'FileDown.do' else {q.lit(_PROFILE.backend_url)} ||
    case doc_id % 3 when 1 then '/download/' || doc_id else '/x/' || doc_id end end as link from documents""")
def download_links(t):
    i = F.col("doc_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("/download/"), i.cast("string"), F.lit("FileDown.do"))) \
        .when(i % 3 == 1, F.concat(F.lit("/download/"), i.cast("string"))) \
        .otherwise(F.concat(F.lit("/x/"), i.cast("string")))
    kind = F.when(i % 4 == 0, "서식").when(i % 4 == 1, " 안내").when(i % 4 == 2, "civil").otherwise("소식")
    return t("documents").select("doc_id", P.offers_attachments(F.concat("source", kind)).alias("offers"),
                                 P.is_own_file_link(url).alias("own_link"), T.resolve_download(url).alias("link"))
