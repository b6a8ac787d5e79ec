"""Page snapshots to raw documents, one plan per source kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import dom as D
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators import links as L
from gleaner.operators import sections as S
from gleaner.operators.bounds import unnest
from gleaner.operators.dedup import keep_first
from gleaner.session import written
from gleaner.sources.pages import with_nodes

_NO_SECTIONS = "array<struct<heading_path:array<string>,block_type:string,text:string>>"


def sections_text(title: Column, menu_path: Column, sections: Column, shortcuts: Column, attachments: Column,
                  files_need_links: bool = True) -> Column:
    """Document text of a general page: title, menu path, sections under their paths, links and files.

    Attachments are listed only beside shortcut links unless ``files_need_links`` is false.
    """
    state = "struct<parts:array<string>,path:array<string>>"

    def label(s):
        kind = s["block_type"]
        return F.when(kind == "table", F.array(F.concat(F.lit("[표]\n"), s["text"]))) \
            .when(kind == "list", F.array(F.concat(F.lit("[목록]\n"), s["text"]))) \
            .when(kind == "definition_list", F.array(F.concat(F.lit("[정의목록]\n"), s["text"]))) \
            .when(kind == "full_text_backup", F.array(F.lit("[전체 본문]"), s["text"])) \
            .otherwise(F.array(s["text"]))

    def step(acc, s):
        moved = (F.size(s["heading_path"]) > 0) & (s["heading_path"] != acc["path"])
        path_line = F.when(moved, F.array(F.array_join(s["heading_path"], " > "))).otherwise(
            F.array().cast("array<string>"))
        return F.struct(F.concat(acc["parts"], path_line, label(s)).alias("parts"),
                        F.when(moved, s["heading_path"]).otherwise(acc["path"]).alias("path"))

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("parts"), none.alias("path")).cast(state)
    body = F.aggregate(sections, start, step)["parts"]
    files = F.concat(F.array(F.lit("[첨부파일]")), F.transform(attachments, lambda f: F.concat(F.lit("- "), f["filename"])))
    links = F.concat(F.array(F.lit("[바로가기 링크]")), F.transform(
        shortcuts, lambda x: F.concat(F.lit("- "), x["text"], F.lit(": "), x["url"])))
    has_links = F.size(shortcuts) > 0
    show_files = (F.size(attachments) > 0) & (has_links if files_need_links else F.lit(True))
    parts = F.concat(
        F.when(title != "", F.array(F.concat(F.lit("제목: "), title))).otherwise(none),
        F.when(F.size(menu_path) > 0, F.array(F.concat(F.lit("메뉴경로: "), F.array_join(menu_path, " > ")))).otherwise(none),
        F.when(F.size(sections) > 0, F.concat(F.array(F.lit("[섹션 구조]")), body)).otherwise(none),
        F.when(show_files, files).otherwise(none), F.when(has_links, links).otherwise(none))
    return T.remove_noise_lines(T.clean_text(F.array_join(parts, "\n\n")))


def page_facts(nodes: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, *more: Column, key: str = "page_id") -> DataFrame:
    """What a general page holds whatever way it is reached: title, metadata, sections, links and files.

    ``nodes`` (page_id, url, nodes) is a written node table; further columns are added as given (over ``nodes`` and ``main``). ``key`` is
    unique per page.
    """
    nodes = S.with_main(nodes, S.best_content(F.col("nodes"), signals=profile.menu_signals))
    sections = S.collect_sections(S.page_sections(nodes, key), key)
    tree, url = F.col("nodes"), F.col("url")
    found = L.anchors(tree, F.col("main"))
    facts = nodes.select(
        "page_id", "url", L.page_title(tree, profile).alias("title"),
        T.let(D.page_text(tree), T.page_metadata).alias("meta"),
        F.coalesce(L.shortcut_links(found, url, profile), F.array()).alias("shortcut_links"),
        F.coalesce(L.page_attachments(found, url, profile), F.array()).alias("attachments"), *more)
    return facts.join(sections, key, "left").withColumn(
        "sections", F.coalesce("sections", F.array().cast(_NO_SECTIONS)))


def documents_of(facts: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, files_need_links: bool = True) -> DataFrame:
    """General documents with ``score`` of facts and the way a page was reached (parent_url, anchor_text, menu_path)."""
    url = F.col("url")
    text = sections_text(F.col("title"), F.col("menu_path"), F.col("sections"), F.col("shortcut_links"),
                         F.col("attachments"), files_need_links)
    return facts.withColumn("text", text).select(
        "page_id", T.text_id(url).alias("doc_id"), "url", "parent_url", "anchor_text", "menu_path",
        U.top_menu(url, profile.top_menus).alias("top_menu"), U.page_type(url).alias("page_type"), "title",
        "meta.department", "meta.date", "meta.views", "sections", "shortcut_links", "attachments",
        F.size("attachments").alias("attachment_count"), "text", T.paragraphs(F.col("text")).alias("paragraphs"),
        F.lit(profile.source).alias("source"),
        P.document_score(url, F.col("title"), F.col("text"), F.size("sections"), profile.menu_signals).alias("score"))


def general_documents(pages: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, files_need_links: bool = True
                      ) -> DataFrame:
    """General documents with ``score``; ``pages`` (page_id, url, html, parent_url, anchor_text, menu_path)."""
    nodes = written(with_nodes(pages), "nodes")
    reached = nodes.select("page_id", "parent_url", "anchor_text", "menu_path")
    return documents_of(page_facts(nodes.drop("parent_url", "anchor_text", "menu_path"), profile).join(reached, "page_id"), profile, files_need_links)


def saved_documents(docs: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, year: int = lx.CURRENT_YEAR,
                    order: str | None = None) -> DataFrame:
    """General documents worth keeping: savable page, enough text, score not negative.

    With ``order`` (a unique column) only the first document of each ``doc_id`` stays.
    """
    kept = docs.where(P.should_save(F.col("url"), F.col("anchor_text"), profile, year)
                      & P.long_enough(F.col("text"), 80) & (F.col("score") >= 0))
    return keep_first(kept, ["doc_id"], order, wide=True) if order else kept


def form_documents(pages: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """Civil form documents of (page_id, url, html) rows; pages without the first label are left out."""
    nodes = with_nodes(pages, lx.FORM_NOISE_SELECTORS)
    nodes = S.with_main(nodes, S.longest_content(F.col("nodes")))
    tree, url = F.col("nodes"), F.col("url")
    read = nodes.select(
        "page_id", "url", T.clean_inline(D.line_text(tree, F.col("main"))).alias("main_text"),
        L.form_attachments(L.anchors(tree), url, profile).alias("attachments"))
    read = read.withColumn("body", T.form_body(F.col("main_text"))).where(F.col("body").contains(lx.FORM_LABELS[0]))
    read = read.withColumn("title", T.form_title(F.col("main_text"))).withColumn("fields", T.form_fields(F.col("body")))
    fields = F.col("fields")
    listed = F.transform(
        F.filter(F.array(*[F.struct(F.lit(x).alias("k"), fields[x].alias("v")) for x in lx.FORM_LABELS]),
                 lambda p: p["v"] != ""), lambda p: F.concat(p["k"], F.lit(": "), p["v"]))
    names = F.array_join(F.transform("attachments", lambda a: a["filename"]), ", ")
    files = F.when(F.size("attachments") > 0, F.array(F.concat(F.lit("첨부파일: "), names))).otherwise(
        F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array(F.concat(F.lit("제목: "), F.col("title"))), listed, files), "\n")
    return read.select(
        "page_id", T.text_id(url).alias("doc_id"), "url", F.lit("civil_form_guide").alias("page_type"), "title",
        *[fields[label].alias(c) for label, c in zip(lx.FORM_LABELS, lx.FORM_COLUMNS, strict=True)], "attachments",
        F.size("attachments").alias("attachment_count"), "fields", text.alias("text"),
        F.lit(profile.source).alias("source"))


def target_forms(docs: DataFrame) -> DataFrame:
    return docs.where(P.is_target_form(*[F.col(c) for c in ("title", "category", "required_documents", "notes", "text")]))


def notice_documents(pages: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE,
                     menu_path=("정보공개", None, "입찰정보")) -> DataFrame:
    """Bid notices of (page_id, notice_id, html) rows."""
    menu = [m or f"{profile.name}알림" for m in menu_path]
    start = F.lit(profile.notice_start_url)
    nodes = with_nodes(pages, lx.BID_NOISE_SELECTORS)
    tree = F.col("nodes")
    visible = F.filter(tree, lambda n: (n["tag"] == "#text") & ~n["noise"])
    full = T.clean_text(F.array_join(F.transform(visible, lambda n: n["text"]), "\n"), trailing_blanks=False)
    # every step is made once, in a generator: the filter on the text below would otherwise repeat all of them
    read = unnest(nodes, ["page_id", "notice_id"], F.array(F.struct(
        full.alias("full"), L.notice_attachments(L.anchors(tree), profile).alias("attachments"))), "full")
    body = F.col("full")

    def field(*labels):
        return T.notice_field(body, labels)

    docs = unnest(read, ["page_id", "notice_id", "attachments"], F.array(F.struct(
        F.coalesce(F.nullif(field("제목"), F.lit("")), F.lit("입찰공고")).alias("title"),
        field("고시공고구분").alias("notice_type"), field("고시공고번호").alias("notice_no"), field("작성일").alias("date"),
        F.coalesce(F.nullif(field("담당부서"), F.lit("")), F.lit("재무과")).alias("department"),
        field("담당자 연락처", "전화번호", "연락처").alias("phone"), T.notice_body(body).alias("body"))), "title")
    files = F.array_join(F.transform("attachments", lambda a: F.concat(
        F.lit("- "), a["file_name"], F.lit(" ("), a["file_url"], F.lit(")"))), "\n")
    text = T.clean_text(F.concat(
        F.lit("제목: "), F.col("title"), F.lit("\n메뉴경로: " + " > ".join(menu) + "\n분류: 입찰정보\n고시공고구분: "),
        F.col("notice_type"), F.lit("\n고시공고번호: "), F.col("notice_no"), F.lit("\n작성일: "), F.col("date"),
        F.lit("\n담당부서: "), F.col("department"), F.lit("\n담당자 연락처: "), F.col("phone"), F.lit("\n상세URL: "), start,
        F.lit("\n\n첨부파일:\n"), files, F.lit("\n\n[본문]\n"), F.col("body")), trailing_blanks=False)
    docs = unnest(docs, docs.columns, F.array(F.struct(text.alias("text"))), "text").where(P.long_enough(F.col("text"), 80))
    return docs.select(
        "page_id", T.notice_id(start, F.col("notice_id")).alias("doc_id"),
        F.concat(start, F.lit("#notice-"), F.col("notice_id")).alias("url"), start.alias("display_url"),
        start.alias("source_url"), F.lit(profile.notice_list_url).alias("list_url"), "notice_id",
        F.concat(F.lit("not_ancmt_mgt_no="), F.col("notice_id")).alias("detail_key"),
        F.lit("bid_notice").alias("page_type"), F.lit("입찰정보").alias("category"), "title", "notice_type", "notice_no",
        "date", "department", "phone", "attachments", "body", F.array(*[F.lit(m) for m in menu]).alias("menu_path"),
        "text", T.paragraphs_nonblank(F.col("text")).alias("paragraphs"),
        F.lit(profile.notice_source).alias("source"))


def waste_documents(pages: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """Waste guide documents; ``pages`` (page_id, url, html, category, topic)."""
    nodes = written(with_nodes(pages, lx.WASTE_NOISE_SELECTORS), "nodes")
    nodes = S.with_main(nodes, S.first_content(F.col("nodes")))
    sections = S.collect_sections(S.waste_sections(nodes), order=("section_pos", "sub"))
    tree = F.col("nodes")
    menu = F.array(F.lit("분야별정보"), F.lit("환경/청소"), F.lit("폐기물"), F.col("category"), F.col("topic"))
    facts = nodes.select(
        "page_id", "url", "category", "topic", menu.alias("menu_path"),
        L.first_title_part(tree, F.col("topic")).alias("title"),
        T.let(D.page_text(tree), T.waste_metadata).alias("meta"))
    docs = facts.join(sections, "page_id", "left").withColumn(
        "sections", F.coalesce("sections", F.array().cast(_NO_SECTIONS)))

    def part(s):
        path = F.array_join(s["heading_path"], " > ")
        body = F.when(s["block_type"] == "table", F.concat(F.lit("[표]\n"), s["text"])) \
            .when(s["block_type"] == "list", F.concat(F.lit("[목록]\n"), s["text"])).otherwise(s["text"])
        return F.when(path != "", F.array(F.concat(F.lit("[SECTION] "), path), body)).otherwise(F.array(body))

    head = F.array(
        F.concat(F.lit("제목: "), F.col("title")), F.concat(F.lit("메뉴경로: "), F.array_join("menu_path", " > ")),
        F.concat(F.lit("분류: "), F.col("category")), F.concat(F.lit("주제: "), F.col("topic")), F.lit("[섹션 구조]"))
    text = T.clean_text(F.array_join(F.concat(head, F.flatten(F.transform("sections", part))), "\n\n"),
                        trailing_blanks=False)
    docs = docs.withColumn("text", text).where(P.long_enough(F.col("text"), 100))
    url = F.col("url")
    return docs.select(
        "page_id", T.text_id(url).alias("doc_id"), "url", U.menu_id(url).alias("mId"),
        F.lit(profile.waste_parent_url).alias("parent_url"), "menu_path", F.lit("waste_guide").alias("page_type"),
        "category", "sections", "topic", "title", F.lit("").alias("author"), "meta.date", "meta.views", "text",
        T.paragraphs_nonblank(F.col("text")).alias("paragraphs"), T.key_lines(F.col("text")).alias("key_sections"),
        F.lit(profile.source).alias("source"), "meta.department", "meta.phone")


def passport_documents(files: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """Passport form documents of a file inventory joined with decoded texts.

    ``files`` (doc_id, file_name, title, file_path, pdf_text); files without text are left out.
    """
    menu = ["외교부 여권안내", "여권기본사항", "신청서식 모음"]
    body = T.clean_text(F.col("pdf_text"), trailing_blanks=False, carriage_returns=False)
    text = T.clean_text(F.concat(
        F.lit("제목: "), F.col("title"), F.lit("\n메뉴경로: " + " > ".join(menu) + "\n출처페이지: " + profile.passport_url
                                             + "\n\n[서식 정보]\n서식명: "),
        F.col("title"), F.lit("\n파일명: "), F.col("file_name"), F.lit("\n\n[PDF 본문]\n"), body),
        trailing_blanks=False, carriage_returns=False)
    return files.where(body != "").select(
        "doc_id", F.lit(profile.passport_url).alias("url"), F.lit("").alias("parent_url"),
        F.col("title").alias("anchor_text"), F.array(*[F.lit(m) for m in menu]).alias("menu_path"),
        F.lit("passport_form_pdf").alias("page_type"), "title", F.lit("외교부 여권과").alias("author"),
        F.lit("").alias("date"), F.lit("").alias("views"), text.alias("text"),
        T.nonblank_lines(text).alias("paragraphs"), F.lit(profile.passport_source).alias("source"),
        F.array(F.struct(F.col("file_name").alias("name"), F.col("file_path").alias("url"),
                         F.lit("pdf").alias("type"))).alias("attachments"))
