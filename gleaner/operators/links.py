"""Anchors of pages and what becomes of them: menu links, shortcuts, attachments, notice ids, board rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import dom as D
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators.bounds import small, unnest
from gleaner.operators.dedup import keep_first, keep_last_value, keep_longest
from gleaner.sources.pages import TABLE

# attributes that hold lists of words, not one string
_LIST_ATTRS = ("class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone")


def page_title(nodes: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, selectors=lx.TITLE_SELECTORS) -> Column:
    """First part of the title tag without listing suffixes, else the first usable heading."""

    def trimmed(c):
        c = F.regexp_replace(c, r"\s*목록\s*\z", "")
        return T.strip(F.regexp_replace(c, r"\s*상세\s*\z", ""))

    raw = D.flat_text(nodes, D.first(F.filter(nodes, lambda n: n["tag"] == "title")))
    head = D.first(F.filter(F.transform(F.split(raw, r"\|"), T.clean_inline), lambda p: p != ""))
    found = F.array(head, *[D.flat_text(nodes, D.first(D.select(nodes, s))) for s in selectors])
    usable = F.filter(F.transform(found, trimmed), lambda c: F.length(c).between(2, 120) & ~P.is_bad_title(c, profile))
    return F.coalesce(D.first(usable), F.lit(""))


def first_title_part(nodes: Column, fallback: Column) -> Column:
    raw = D.flat_text(nodes, D.first(F.filter(nodes, lambda n: n["tag"] == "title")))
    return F.coalesce(D.first(F.filter(F.transform(F.split(raw, r"\|"), T.clean_inline), lambda p: p != "")), fallback)


def anchors(nodes: Column, within: Column | None = None) -> Column:
    """array<struct> of the ``a`` elements of a page, or of the noise-free ones below a node."""
    whole = within is None
    found = F.filter(nodes, lambda n: n["tag"] == "a") if whole else D.descendants(nodes, within, "a")

    def row(a):
        parent = F.get(nodes, a["parent"])
        plain = F.map_filter(a["attrs"], lambda k, _: ~k.isin(*_LIST_ATTRS))
        return F.struct(
            a["pos"].cast("bigint").alias("pos"),
            T.strip(D.attr(a, "href")).alias("href"),
            F.map_contains_key(a["attrs"], "href").alias("has_href"),
            T.strip(D.attr(a, "onclick")).alias("onclick"),
            T.clean_inline(D.attr(a, "title")).alias("title"),
            T.clean_inline(D.attr(a, "download")).alias("download"),
            D.attr(a, "target").alias("target"),
            D.flat_text(nodes, a, keep_noise=whole).alias("text"),
            F.coalesce(D.flat_text(nodes, parent, keep_noise=whole), F.lit("")).alias("around"),
            F.concat(F.array(D.attr(a, "href"), D.attr(a, "onclick")), F.map_values(plain)).alias("values"),
        )

    return F.transform(found, row)


def anchor_rows(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, pos, href, text, ...) of every anchor of every page."""
    return unnest(pages, [key, url], anchors(F.col("nodes")), "pos")


# -- links to follow --------------------------------------------------------------------------


def hidden_menu_id(values: Column) -> Column:
    """Ten-digit menu id in any attribute, first attribute first."""
    ids = F.transform(values, lambda v: F.coalesce(
        F.nullif(F.regexp_extract(v, "mId=([0-9]{10})", 1), F.lit("")),
        F.nullif(F.regexp_extract(v, "['\"]([0-9]{10})['\"]", 1), F.lit(""))))
    return F.coalesce(D.first(F.filter(ids, lambda x: x.isNotNull())), F.lit(""))


def menu_links(rows: DataFrame, menu_path: Column | None = None, key: str = "page_id", url: str = "url",
               profile: lx.SiteProfile = lx.DEFAULT_PROFILE, year: int = lx.CURRENT_YEAR, label_length: int = 60) -> DataFrame:
    """(key, pos, link_url, anchor_text, menu_path) to be crawled from each page, unique per page and url.

    ``rows`` are anchor rows; of several links to one url the one with the longest path stays.
    """
    path = F.array().cast("array<string>") if menu_path is None else menu_path
    kept = _links_to_follow(rows, url, profile, year)
    text = F.col("anchor_text")
    extend = (text != "") & ~F.array_contains(path, text) & (F.length(text) <= label_length)
    full = F.when(extend, F.concat(path, F.array(text))).otherwise(path)
    out = kept.select(key, "pos", "link_url", "anchor_text", full.alias("menu_path"))
    return keep_longest(out, [key, "link_url"], F.size("menu_path"), "pos")


def page_links(rows: DataFrame, url: str = "url", profile: lx.SiteProfile = lx.DEFAULT_PROFILE, year: int = lx.CURRENT_YEAR) -> DataFrame:
    """(url, pos, link_url, labels) to be crawled from each page, unique per page and link: where the link stands first, and
    all its labels in order. Which label counts depends on the menu path by which the page is reached."""
    kept = _links_to_follow(rows, url, profile, year)
    labels = F.array_sort(F.collect_list(F.struct("pos", "anchor_text")))
    return kept.groupBy(F.col(url).alias("url"), "link_url").agg(F.min("pos").alias("pos"), labels.alias("l")).select(
        "url", "pos", "link_url", F.array_distinct("l.anchor_text").alias("labels"))


def _links_to_follow(rows: DataFrame, url: str, profile: lx.SiteProfile, year: int) -> DataFrame:
    label = F.when(F.col("text") != "", F.col("text")).otherwise(
        T.strip(F.replace(F.col("title"), F.lit("선택됨"), F.lit(""))))
    hidden = hidden_menu_id(F.col("values"))
    href = F.when(hidden != "", F.concat(F.lit("/portal/contents.do?mId="), hidden)).otherwise(F.col("href"))
    named = rows.withColumn("anchor_text", label).withColumn("_href", href).where("_href <> ''") \
        .withColumn("link_url", U.normalize_url(F.col(url), F.col("_href"), profile.hosts))
    return named.where(
        F.col("link_url").isNotNull()
        & ~P.is_shortcut_only(F.col("anchor_text"), F.col("_href"), profile)
        & P.is_allowed_url(F.col("link_url"), profile)
        & P.is_recent_year_label(F.col("anchor_text"), year)
    )


# -- shortcuts --------------------------------------------------------------------------------

SHORTCUTS = "array<struct<text:string,url:string,raw_href:string>>"


def _groups(items: Column, names: tuple[str, ...], made) -> Column:
    """``made`` of the items that start an equal-key group (in key order, each with its place ``i``) and of those that end it.

    One sort instead of a look at all items per key.
    """
    keyed = F.transform(items, lambda x, i: F.struct(F.struct(*[x[n].alias(n) for n in names]).alias("k"), i.alias("i"), x.alias("x")))

    def edges(s):
        starts = F.filter(s, lambda x, i: (i == 0) | ~F.get(s, i - 1)["k"].eqNullSafe(x["k"]))
        ends = F.filter(s, lambda x, i: (i == F.size(s) - 1) | ~F.get(s, i + 1)["k"].eqNullSafe(x["k"]))
        return F.transform(F.array_sort(made(starts, ends)), lambda x: x["x"])

    return T.let(F.array_sort(keyed), edges)


def last_value_by(items: Column, *names: str) -> Column:
    """Map semantics inside one array: an equal key keeps its first place and its last value."""
    return _groups(items, names, lambda starts, ends: F.zip_with(
        starts, ends, lambda a, b: F.struct(a["i"].alias("i"), b["x"].alias("x"))))


def first_by(items: Column, *names: str) -> Column:
    """First element per key inside one array."""
    return _groups(items, names, lambda starts, _: F.transform(starts, lambda a: F.struct(a["i"].alias("i"), a["x"].alias("x"))))


def _without_window_note(c: Column) -> Column:
    return T.strip(F.replace(F.replace(c, F.lit("새창으로열림"), F.lit("")), F.lit("새창"), F.lit("")))


def shortcut_links(found: Column, url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    """Shortcut links among a page's main anchors (see :func:`anchors`), unique by label and url."""
    is_url = r"^https?://[^ ]+\z"

    def shaped(a):
        # a bare url as label gives way to the text around it
        around = T.strip(F.regexp_replace(a["around"], r"https?://\S+", ""))
        label = F.when(a["text"].rlike(is_url) & (F.length(around) >= 2), around).otherwise(a["text"])
        return F.struct(_without_window_note(label).alias("text"), U.resolve(url, a["href"]).alias("url"),
                        a["href"].alias("raw_href"))

    def with_host_name(x):
        host = F.lower(U.host(x["url"]))
        label = x["text"]
        for part, name in reversed(lx.HOST_LABELS):
            label = F.when(host.contains(part), F.lit(name)).otherwise(label)
        return F.struct(
            F.when((x["text"] == "") | x["text"].rlike(is_url), label).otherwise(x["text"]).alias("text"),
            x["url"].alias("url"), x["raw_href"].alias("raw_href"))

    linked = F.filter(found, lambda a: a["has_href"] & P.has_page_scheme(a["href"]))
    named = F.transform(F.transform(linked, shaped), with_host_name)
    # download links are attachments, not shortcuts
    valid = F.filter(named, lambda x: ~F.lower(x["url"]).rlike("filedown|download")
                     & P.is_valid_shortcut(x["text"], x["raw_href"], x["url"], profile))
    return last_value_by(valid, "text", "url")


def menu_shortcuts(found: Column, url: Column, labels=lx.MENU_SHORTCUTS) -> Column:
    """New-window links of a start page whose label is one of the saved ones."""
    opened = F.filter(found, lambda a: a["has_href"] & (a["text"].contains("새창") | (a["target"] == "_blank")))
    named = F.transform(opened, lambda a: F.struct(_without_window_note(a["text"]).alias("text"),
                                                   U.resolve(url, a["href"]).alias("url"),
                                                   a["href"].alias("raw_href")))
    return F.filter(named, lambda x: x["text"].isin(*labels))


def start_page_flags(pages: DataFrame, start_urls: DataFrame, url: str = "url") -> DataFrame:
    """Pages with ``is_start``: whether their url is among the start urls (any number of them)."""
    starts = start_urls.select(F.col(url).alias("_start")).distinct()
    return pages.join(small(starts, F.octet_length("_start")), F.col(url) == F.col("_start"), "left").withColumn(
        "is_start", F.col("_start").isNotNull()).drop("_start")


def page_shortcuts(pages: DataFrame, start_urls=(), key: str = "page_id", url: str = "url",
                   profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """(key, url, n, text, link_url, raw_href): main shortcuts, and menu shortcuts of start pages.

    Start pages are those of ``start_urls``, or those flagged by ``is_start`` if the pages have that column.
    """
    nodes, at = F.col("nodes"), F.col(url)
    none = F.array().cast(SHORTCUTS)
    starts = F.col("is_start") if "is_start" in pages.columns else at.isin(*start_urls)
    menu = F.when(starts, menu_shortcuts(anchors(nodes), at)).otherwise(none)
    body = pages.select(key, url, F.concat(F.coalesce(shortcut_links(anchors(nodes, F.col("main")), at, profile), none), menu).alias("found"))
    return shortcut_rows(body, key, url)


def shortcut_rows(found: DataFrame, *keep: str) -> DataFrame:
    """One row per shortcut of ``found`` (an array column), unique by label, url and raw link, with the columns ``keep``."""
    made = found.select(*keep, F.posexplode_outer(last_value_by(F.col("found"), "text", "url", "raw_href")).alias("n", "s")).where("n is not null")
    return made.select(*keep, F.col("n").cast("bigint").alias("n"), F.col("s.text"), F.col("s.url").alias("link_url"),
                       F.col("s.raw_href"))


def shortcut_documents(shortcuts: DataFrame, order: str, profile: lx.SiteProfile = lx.DEFAULT_PROFILE,
                       page_type: str = "menu_shortcut") -> DataFrame:
    """Shortcut documents, one per link url (first in ``order``).

    ``shortcuts`` (url, menu_path, text, link_url, raw_href, order).
    """
    kept = keep_first(shortcuts.where("link_url <> ''"), ["link_url"], order)
    label, link, page = F.col("text"), F.col("link_url"), F.col("url")
    body = F.concat(
        F.lit("제목: "), label, F.lit("\n 상위문서: \n 메뉴경로: "), F.array_join("menu_path", " > "),
        F.lit("\n 분류: 바로가기 링크\n 바로가기명: "), label, F.lit("\n 바로가기URL: "), link,
        F.lit("\n 원본페이지: "), page)
    return kept.select(
        T.shortcut_id(page, label, link).alias("doc_id"), link.alias("url"), page.alias("source_url"),
        F.lit(page_type).alias("page_type"), F.lit("바로가기").alias("category"), label.alias("title"),
        F.lit("").alias("parent_title"), label.alias("shortcut_name"), "menu_path", link.alias("shortcut_url"),
        "raw_href", T.clean_text(body).alias("text"), F.array(T.clean_text(body)).alias("paragraphs"),
        F.lit(profile.source).alias("source"))


# -- attachments ------------------------------------------------------------------------------


def page_attachments(found: Column, url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    """Attachments of a general page, unique by name and url."""
    extension = r"(?i)\.(?:" + lx.FILE_EXTENSIONS + ")"

    def named(a):
        file_id, file_sn = T.download_ids(a["onclick"])
        linked = (a["href"] != "") & ~a["href"].isin("#", "javascript:void(0);") & (
            a["href"].rlike(extension) | F.lower(a["href"]).contains("download")
            | a["href"].rlike("FileDown\\.do|fileDown"))
        target = F.when(file_id != "", T.download_url(file_id, file_sn, profile.file_down_url)).when(
            linked, U.resolve(url, a["href"])).otherwise("")
        return F.struct(T.attachment_name(a["download"], a["title"], a["text"], a["around"]).alias("filename"),
                        target.alias("file_url"), file_id.alias("file_id"), file_sn.alias("file_sn"))

    def finished(x):
        fallback = F.when(x["file_id"] != "", F.concat(F.lit("첨부파일_"), x["file_id"], F.lit("_"), x["file_sn"])) \
            .otherwise("첨부파일")
        bare = (x["filename"] == "") | x["filename"].isin("다운로드", "내려받기", "파일다운로드")
        name = F.when(bare, fallback).otherwise(x["filename"])
        return F.struct(name.alias("filename"), x["file_url"].alias("file_url"),
                        T.file_extension(name).alias("extension"), x["file_id"].alias("file_id"),
                        x["file_sn"].alias("file_sn"), F.lit("site_attachment").alias("source_type"))

    usable = F.filter(F.transform(found, named), lambda x: x["file_url"] != "")
    return first_by(F.transform(usable, finished), "filename", "file_url")


def form_attachments(found: Column, url: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    """Attachments of a form page: only anchors whose text holds a file extension."""

    def made(a):
        file_id, file_sn = T.download_ids(a["onclick"], public_variant=False)
        name = T.drop_size_suffix(T.drop_size_suffix(a["text"], "KByte", False), "MByte", False)
        target = F.when(file_id != "", T.download_url(file_id, file_sn, profile.file_down_url)).when(
            (a["href"] != "") & (a["href"] != "#"), U.resolve(url, a["href"])).otherwise("")
        return F.struct(T.clean_inline(name).alias("filename"), target.alias("file_url"),
                        T.file_extension(name).alias("extension"), file_id.alias("file_id"),
                        file_sn.alias("file_sn"))

    files = F.filter(found, lambda a: T.file_extension(a["text"]) != "")
    return first_by(F.filter(F.transform(files, made), lambda x: x["file_url"] != ""), "filename", "file_url")


def notice_attachments(found: Column, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> Column:
    """Attachments of a notice page; script links keep their text and an empty url."""
    named = F.filter(found, lambda a: a["has_href"]
                     & a["text"].rlike(r"(?i)\.(?:" + lx.FILE_EXTENSIONS + r")\z"))
    return F.transform(named, lambda a: F.struct(
        a["text"].alias("file_name"), U.notice_file_url(a["href"], profile).alias("file_url"),
        a["href"].alias("raw_href")))


# -- notice ids and listings ------------------------------------------------------------------

_DETAIL_CALL = r"searchDetail\(['\"]?([^'\")]+)['\"]?\)"


def notice_ids(pages: DataFrame, html: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, notice_id, anchor_text, ord) of all numeric ids in script calls, of anchors and of raw text.

    A later mention overrides an earlier one's label; the raw-text mentions come last.
    """
    from_anchors = unnest(pages, [key], anchors(F.col("nodes")), "pos").select(
        key, F.col("pos").alias("ord"),
        F.regexp_extract(F.concat_ws(" ", "href", "onclick"), _DETAIL_CALL, 1).alias("notice_id"),
        F.col("text").alias("anchor_text"))
    in_text = F.regexp_extract_all(F.col("html"), F.lit(_DETAIL_CALL), F.lit(1))
    from_text = html.select(key, F.posexplode(in_text).alias("n", "notice_id")).select(
        key, (F.lit(1 << 40) + F.col("n")).alias("ord"), "notice_id", F.lit("").alias("anchor_text"))
    found = from_anchors.unionByName(from_text).where(F.col("notice_id").rlike(r"^[0-9]+\z"))
    return keep_last_value(found.select(key, "notice_id", "anchor_text", "ord"), [key, "notice_id"], "ord")


def notice_list_url(found: Column, url: Column) -> Column:
    """Url of the first anchor that leads to the notice listing, empty if none."""
    hits = F.filter(found, lambda a: a["has_href"] & (a["href"].contains("OfrNotAncmtLSub.jsp")
                                                     | a["text"].contains("입찰정보")))
    return F.coalesce(D.first(F.transform(hits, lambda a: U.resolve(url, a["href"]))), F.lit(""))


def form_view_links(found: Column, url: Column) -> Column:
    """Distinct urls of form detail pages in a listing, in page order."""
    full = F.transform(F.filter(found, lambda a: a["has_href"]), lambda a: U.resolve(url, a["href"]))
    return F.array_distinct(F.filter(full, lambda u: u.contains("/portal/civil/view.do") & u.contains("civilId=")))


def board_rows(pages: DataFrame, key: str = "page_id", url: str = "url",
               profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """(key, row_no, number, title, department, date, views, url) of a listing page's table rows."""
    nodes = F.col("nodes")
    rows = F.filter(nodes, lambda n: (n["tag"] == "tr") & (n["inside"].bitwiseAND(F.lit(TABLE)) != 0))

    def shaped(r):
        cells = F.filter(D.subtree(nodes, r), lambda n: D.has_tag(n, "th", "td"))
        link = D.first(F.filter(D.subtree(nodes, r), lambda n: D.has_tag(n, "a")
                                & F.map_contains_key(n["attrs"], "href")))
        return F.struct(
            F.transform(cells, lambda c: D.flat_text(nodes, c, keep_noise=True)).alias("cells"),
            D.attr(link, "href").alias("href"),
            D.flat_text(nodes, link, keep_noise=True).alias("title"),
        )

    made = pages.select(key, url, F.posexplode_outer(F.transform(rows, shaped)).alias("row_no", "r")).where("row_no is not null").select(
        key, url, F.col("row_no").cast("bigint").alias("row_no"), "r.cells", "r.href", "r.title")
    cells = F.col("cells")
    joined = F.col("joined")
    day = r"(20[0-9]{2})[./-]([0-9]{1,2})[./-]([0-9]{1,2})"
    date = F.when(joined.rlike(day), F.concat_ws(
        "-", F.regexp_extract(joined, day, 1), F.lpad(F.regexp_extract(joined, day, 2), 2, "0"),
        F.lpad(F.regexp_extract(joined, day, 3), 2, "0"))).otherwise("")
    numeric = F.filter(cells, lambda c: c.rlike(r"^[0-9][0-9,]*\z"))
    usable = made.where((F.size(cells) >= 3) & (F.col("href") != ""))
    # each value is made once, in a generator; a plain column would be made again for every mention of it
    link_url = U.normalize_url(F.col(url), F.col("href"), profile.hosts)
    usable = unnest(usable, usable.columns, F.array(F.struct(link_url.alias("link_url"), F.array_join(cells, " | ").alias("joined"))), "link_url")
    usable = unnest(usable, usable.columns, F.array(F.struct(date.alias("date"))), "date")
    # the cell in front of the first one showing the date
    dated = F.transform(cells, lambda c, i: F.when(
        (F.col("date") != "") & (c.contains(F.replace(F.col("date"), F.lit("-"), F.lit("."))) | c.contains(F.col("date"))),
        i))
    at = D.first(F.filter(dated, lambda i: i.isNotNull()))
    return usable.select(
        key, "row_no", F.get(cells, F.lit(0)).alias("number"), "title",
        F.when(at > 0, F.get(cells, at - 1)).otherwise("").alias("department"), "date",
        T.normalize_views(F.try_element_at(numeric, F.lit(-1))).alias("views"), F.col("link_url").alias("url"))
