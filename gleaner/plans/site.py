"""A whole site snapshot to documents: crawl, boards, shortcuts and keep rules as one set of joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import predicates as P
from gleaner.functions import urls as U
from gleaner.operators import links as L
from gleaner.operators.frontier import expand_frontier
from gleaner.operators.listing import kept_listing_rows, overlay_listing
from gleaner.plans.documents import documents_of, page_facts, saved_documents
from gleaner.session import written
from gleaner.sources.pages import with_nodes

_PAGE_NO = r"[?&]page=([0-9]+)\z"


@dataclass
class Site:
    """``visits``: every url reached and how; ``pages`` and ``shortcuts``: the documents kept."""

    visits: DataFrame
    pages: DataFrame
    shortcuts: DataFrame


def board_pages(listings: DataFrame) -> DataFrame:
    """(board, page_no, url) of listing pages: each is page one of itself, and page n of the url without its page number."""
    itself = listings.select(F.col("url").alias("board"), F.lit(1).cast("long").alias("page_no"), "url")
    number = F.try_to_number(F.regexp_extract("url", _PAGE_NO, 1), F.lit("999999999999999999")).cast("long")
    later = listings.select(F.regexp_replace("url", _PAGE_NO, "").alias("board"), number.alias("page_no"), "url").where("page_no > 1")
    return itself.unionByName(later)


def listing_rows(nodes: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE, as_of: str = lx.RECENT_AS_OF,
                 days: int = lx.RECENT_DAYS, max_board_pages: int | None = None) -> DataFrame:
    """Rows that boards show before their listing ends: board, page_no, row_no, number, title, department, date, views, url."""
    listings = nodes.where(U.page_type(F.col("url")) == "bbs_list").withColumnRenamed("url", "list_url")
    rows = L.board_rows(listings, "list_url", "list_url", profile)
    placed = board_pages(listings.select(F.col("list_url").alias("url"))).withColumnRenamed("url", "list_url").join(rows, "list_url")
    return kept_listing_rows(placed.drop("list_url"), as_of, days, max_board_pages)


def site_documents(snapshot: DataFrame, seeds: DataFrame, profile: lx.SiteProfile = lx.DEFAULT_PROFILE,
                   as_of: str = lx.RECENT_AS_OF, days: int = lx.RECENT_DAYS, year: int = lx.CURRENT_YEAR,
                   max_board_pages: int | None = None, label_length: int = 60, files_need_links: bool = True) -> Site:
    """All documents that a crawl from the seeds saves.

    ``snapshot`` (page_id, url, html, maybe content_type): of several pages of one url the smallest page_id counts (unique per url), other
    content than html is left out; ``seeds`` (url, menu_path, seq). Each page is tokenised once; facts, links and listing rows come from that one
    written node table. A link without a page in the snapshot is visited and gives nothing.

    Pages of the crawl are kept by type, text and score, board rows by text, with the listing's values laid over the page's.
    Shortcut documents are one per link, from the page visited first.
    """
    if "content_type" in snapshot.columns:
        snapshot = snapshot.where(P.is_html(F.col("content_type")))
    snapshot = snapshot.where("url is not null").select("page_id", "url", "html")
    # only urls and ids are aggregated; the pages follow
    snapshot = snapshot.join(snapshot.groupBy("url").agg(F.min("page_id").alias("page_id")), ["url", "page_id"], "left_semi")
    nodes = written(with_nodes(snapshot), "site-nodes")
    links = written(L.page_links(L.anchor_rows(nodes), "url", profile, year), "site-links")
    rows = written(listing_rows(nodes, profile, as_of, days, max_board_pages), "site-rows")
    visits = written(expand_frontier(seeds, links, claims=rows.select("board", "url", "page_no", "row_no", "title"),
                                     label_length=label_length), "site-visits")
    starts = L.start_page_flags(nodes, seeds)
    menu = F.when(F.col("is_start"), L.menu_shortcuts(L.anchors(F.col("nodes")), F.col("url"))).otherwise(F.array().cast(L.SHORTCUTS))
    facts = written(page_facts(starts, profile, menu.alias("menu_shortcuts"), key="url"), "site-facts")
    reached = facts.join(visits, "url")
    crawled = reached.where("page_no is null")
    pages = saved_documents(documents_of(crawled, profile, files_need_links), profile, year)
    board = documents_of(reached.where("page_no is not null"), profile, files_need_links).where(P.long_enough(F.col("text"), 80))
    shown = rows.select(F.col("board").alias("parent_url"), "page_no", "row_no", "number", "title", "department", "date", "views", "url")
    first = visits.where("page_no is not null").select("url", "parent_url", "page_no", "row_no").join(
        shown, ["url", "parent_url", "page_no", "row_no"]).drop("parent_url", "page_no", "row_no")
    board = overlay_listing(board, first).join(first.select("url", F.nullif("number", F.lit("")).alias("board_number")), "url", "left")
    both = pages.withColumn("board_number", F.lit(None).cast("string")).unionByName(board)
    order = F.struct("depth", "visit", "n").alias("ord")
    found = L.shortcut_rows(crawled.select("url", "menu_path", "depth", "visit", F.concat("shortcut_links", "menu_shortcuts").alias("found")),
                            "url", "menu_path", "depth", "visit")
    shortcuts = L.shortcut_documents(found.select("url", "menu_path", "text", "link_url", "raw_href", order), "ord", profile)
    return Site(visits, both, shortcuts)
