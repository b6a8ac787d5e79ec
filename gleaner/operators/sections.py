"""Pages to sections: main content choice, heading paths, paragraph buffers, structure texts.

Input everywhere is a node table (one row per page, see ``gleaner.sources.pages``). The only shuffle
is one hash exchange on the page key, shared by every window and grouping below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import dom as D
from gleaner.functions import predicates as P
from gleaner.functions import text as T
from gleaner.operators.bounds import unnest
from gleaner.sources.pages import ABOVE, OL, UL

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def _node_at(nodes: Column, pos: Column) -> Column:
    return F.get(nodes, pos)


def _body_pos(nodes: Column) -> Column:
    return D.first(F.filter(nodes, lambda n: n["tag"] == "body"))["pos"]


def best_content(nodes: Column, selectors=lx.CONTENT_SELECTORS, min_length: int = 80, signals=None) -> Column:
    """Position of the best scored content node; ties go to the longer, then the earlier candidate."""
    found = F.flatten(F.array(*[D.select(nodes, s) for s in selectors]))
    texts = F.transform(found, lambda n, i: F.struct(
        T.clean_text(D.line_text(nodes, n)).alias("text"), n["pos"].alias("pos"), (-i).alias("order")))
    ranked = F.transform(
        F.filter(texts, lambda x: F.length(x["text"]) >= min_length),
        lambda x: F.struct(P.node_score(x["text"], signals).alias("score"), F.length(x["text"]).alias("size"),
                           x["order"], x["pos"].alias("pos")),
    )
    return F.coalesce(F.array_max(ranked)["pos"], _body_pos(nodes))


def longest_content(nodes: Column, selectors=lx.FORM_CONTENT_SELECTORS) -> Column:
    """Position of the longest among the first node of each selector; first selector wins ties."""
    found = F.filter(F.array(*[D.first(D.select(nodes, s)) for s in selectors]), lambda n: n.isNotNull())
    ranked = F.transform(found, lambda n, i: F.struct(
        F.length(D.line_text(nodes, n)).alias("size"), (-i).alias("order"), n["pos"].alias("pos")))
    return F.array_max(F.filter(ranked, lambda x: x["size"] > 0))["pos"]


def first_content(nodes: Column, selectors=lx.WASTE_CONTENT_SELECTORS, min_length: int = 50) -> Column:
    """Position of the first selector's node that is long enough."""
    out = _body_pos(nodes)
    for s in reversed(selectors):
        node = D.first(D.select(nodes, s))
        out = F.when(F.length(T.clean_text(D.line_text(nodes, node), trailing_blanks=False)) >= min_length,
                     node["pos"]).otherwise(out)
    return out


def with_main(pages: DataFrame, position: Column) -> DataFrame:
    """Add ``main`` (the content node) for a position expression."""
    return pages.withColumn("main_pos", position).withColumn("main", _node_at(F.col("nodes"), F.col("main_pos"))) \
        .drop("main_pos")


# -- texts of structures ----------------------------------------------------------------------


def list_text(nodes: Column, node: Column) -> Column:
    items = F.transform(D.children(nodes, node, "li"), lambda li: T.lines(D.line_text(nodes, li)))
    return F.array_join(F.flatten(items), "\n")


def table_text(nodes: Column, node: Column) -> Column:
    """One line per row; ``header: cell`` pairs where a head of the same width exists."""
    head = F.flatten(F.transform(
        F.slice(D.descendants(nodes, node, "thead"), 1, 1),
        lambda h: F.transform(D.descendants(nodes, h, "th", "td"), lambda c: D.flat_text(nodes, c))))
    rows = F.transform(D.descendants(nodes, node, "tr"), lambda r: F.filter(
        F.transform(D.descendants(nodes, r, "th", "td"), lambda c: D.flat_text(nodes, c)), lambda x: x != ""))

    def row_text(cells):
        pairs = F.zip_with(head, cells, lambda h, c: F.when(h != "", F.concat(h, F.lit(": "), c)))
        fits = (F.size(head) > 0) & (F.size(head) == F.size(cells))
        return F.array_join(F.when(fits, F.filter(pairs, lambda x: x.isNotNull())).otherwise(cells), " | ")

    return F.array_join(F.transform(F.filter(rows, lambda r: F.size(r) > 0), row_text), "\n")


def definition_text(nodes: Column, node: Column) -> Column:
    def texts(tag):
        return F.transform(D.descendants(nodes, node, tag), lambda n: D.flat_text(nodes, n))

    pairs = F.zip_with(texts("dt"), texts("dd"), lambda k, v: F.when((k != "") & (v != ""),
                                                                     F.concat(k, F.lit(": "), v)))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "\n")


# -- heading paths ----------------------------------------------------------------------------


def heading_path(level: Column, title: Column, pos: Column, running, levels=range(1, 7),
                 root: Column | None = None) -> Column:
    """Titles of the open headings at each row.

    A heading of level L closes every level >= L, so level k is open exactly if its latest heading
    came after the latest heading of every lower level. ``level`` is null on rows that are no heading.
    """
    latest = []
    for k in levels:
        last = F.last(F.when(level == k, F.struct(pos.alias("at"), title.alias("title"))), ignorenulls=True).over(
            running)
        if k == 1 and root is not None:
            start = F.struct(F.lit(-1).cast("bigint").alias("at"), root.alias("title"))
            last = F.coalesce(last, start)
        latest.append(last)
    stack = F.array(*latest)
    opened = F.filter(stack, lambda x, i: x.isNotNull() & F.forall(
        F.slice(stack, F.lit(1), i), lambda lower: lower.isNull() | (lower["at"] < x["at"])))
    return F.transform(opened, lambda x: x["title"])


def _level(tag: Column) -> Column:
    return F.when(tag.isin(*_HEADINGS), F.substring(tag, 2, 1).cast("int")).otherwise(5)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key; partitions already hashed on the leading key are reused."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# -- general pages ----------------------------------------------------------------------------


def page_items(pages: DataFrame, key: str) -> DataFrame:
    """(key, pos, tag, text): strings, headings and structures below ``main`` in document order."""
    nodes, main = F.col("nodes"), F.col("main")
    structures = ["ul", "ol", "table", "dl"]
    wanted = ["#text", "#comment", "strong", "dt", *_HEADINGS, *structures]

    def usable(n):
        loose = ~n["tag"].isin("#text", "#comment") | (n["inside"].bitwiseAND(F.lit(ABOVE)) == 0)
        return n["tag"].isin(*wanted) & ~n["noise"] & loose

    items = F.transform(F.filter(D.subtree(nodes, main), usable), lambda n: F.struct(
        n["pos"].cast("bigint").alias("pos"),
        n["tag"].alias("tag"),
        F.when(n["tag"].isin("#text", "#comment"), T.clean_inline(n["text"]))
        .when(n["tag"].isin("ul", "ol"), list_text(nodes, n))
        .when(n["tag"] == "table", table_text(nodes, n))
        .when(n["tag"] == "dl", definition_text(nodes, n))
        .otherwise(D.flat_text(nodes, n)).alias("text"),
    ))
    backup = F.struct(F.lit(-1).cast("bigint").alias("pos"), F.lit("backup").alias("tag"),
                      D.line_text(nodes, main).alias("text"))
    return unnest(pages, [key], F.concat(F.array(backup), items), "pos")


def page_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, section_pos, heading_path, block_type, text) of general pages.

    ``pages`` needs ``nodes`` and ``main``. Strings before the first heading are dropped; a string run
    between two headings or structures is one paragraph; the whole text comes first as a backup.
    """
    items = page_items(pages, key)
    is_string = F.col("tag").isin("#text", "#comment")
    is_title = F.col("tag").isin("strong", "dt", *_HEADINGS)
    items = items.withColumn("heading", is_title & P.looks_like_heading(F.col("text"))).where(
        ~is_title | F.col("heading")
    ).where(~is_string | ((F.col("text") != "") & ~F.col("text").isin(*lx.SKIPPED_PAGE_STRINGS)))

    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("heading"), _level(F.col("tag")))
    breaks = F.sum(F.when(is_string | (F.col("tag") == "backup"), 0).otherwise(1)).over(running)
    placed = items.select(
        key, "pos", "tag", "text", "heading", is_string.alias("is_string"), breaks.alias("run"),
        heading_path(level, F.col("text"), F.col("pos"), running).alias("path"),
    ).where(~F.col("heading"))

    kind = (
        F.when(F.col("tag") == "backup", "full_text_backup").when(F.col("is_string"), "paragraph")
        .when(F.col("tag").isin("ul", "ol"), "list").when(F.col("tag") == "table", "table")
        .otherwise("definition_list")
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = placed.groupBy(key, "run", kind.alias("block_type")).agg(
        F.min("pos").alias("pos"), F.min("path").alias("path"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("raw"),
    )
    is_backup = F.col("block_type") == "full_text_backup"
    path = F.when(is_backup, F.array(F.lit("전체 본문"))).otherwise(F.col("path"))

    def section(block):
        return F.struct(path.alias("path"), F.when(is_backup, block).otherwise(T.clean_text(block)).alias("text"))

    def wanted(s):
        last = F.try_element_at(s["path"], F.lit(-1))
        return F.when(is_backup, s["text"] != "").otherwise(
            (F.length(s["text"]) >= 3)
            & ((F.col("block_type") != "paragraph") | (F.size(s["path"]) > 0))
            & F.coalesce(s["text"] != last, F.lit(True)))

    made = T.let(T.remove_noise_lines(T.clean_block(F.col("raw"))), section)
    # filtered inside the generator: a plain filter would clean every text again for each mention
    kept = unnest(joined, [key, "pos", "block_type"], F.filter(F.array(made), wanted), "text")
    unique = first_of(kept, [key, "path", "block_type", "text"], ["pos"])
    return unique.select(key, F.col("pos").alias("section_pos"), F.col("path").alias("heading_path"), "block_type",
                         "text")


def collect_sections(sections: DataFrame, key: str = "page_id", order=("section_pos",)) -> DataFrame:
    """One row per page with its ordered ``sections`` array."""
    body = F.struct("heading_path", "block_type", "text")
    ordered = F.array_sort(F.collect_list(F.struct(*order, body.alias("section"))))
    return sections.groupBy(key).agg(F.transform(ordered, lambda x: x["section"]).alias("sections"))


# -- waste guide pages ------------------------------------------------------------------------


def _waste_items(nodes: Column, main: Column) -> Column:
    wanted = ["strong", "dt", "p", "div", "ul", "ol", "table", "dl", *_HEADINGS]

    def item(n, sub, tag, text, direct=None, child=None, has_child=None, has_table=None):
        empty = F.lit("")
        return F.struct(
            n["pos"].cast("bigint").alias("pos"), sub.cast("int").alias("sub"), tag.alias("tag"), text.alias("text"),
            (empty if direct is None else direct).alias("direct"), (empty if child is None else child).alias("child"),
            (F.lit(False) if has_child is None else has_child).alias("has_child"),
            (F.lit(False) if has_table is None else has_table).alias("has_table"),
        )

    def child_text(li):
        inner = F.flatten(F.transform(F.slice(D.children(nodes, li, "ul", "ol"), 1, 1),
                                      lambda u: D.children(nodes, u, "li")))
        texts = F.transform(inner, lambda x: T.clean_block_waste(D.line_text(nodes, x)))
        return F.array_join(F.filter(texts, lambda x: x != ""), "\n")

    def list_items(n):
        return F.transform(D.children(nodes, n, "li"), lambda li, i: item(
            n, i, F.lit("li"), D.line_text(nodes, li), D.direct_text(nodes, li), child_text(li),
            F.size(D.children(nodes, li, "ul", "ol")) > 0, F.size(D.descendants(nodes, li, "table")) > 0))

    def single(n):
        own = F.when(n["tag"].isin("p", "div", "dl"), D.line_text(nodes, n)).otherwise(D.flat_text(nodes, n))
        text = F.when(n["tag"] == "table", F.lit("")).otherwise(own)
        holder = F.when((n["tag"] == "table") & (n["li"] >= 0), F.get(nodes, n["li"]))
        direct = F.when(holder.isNotNull(), D.direct_text(nodes, holder)).otherwise("")
        holds_table = n["tag"].isin("p", "div") & (F.size(D.descendants(nodes, n, "table")) > 0)
        return F.array(item(n, F.lit(0), n["tag"], text, direct, None, None, holds_table))

    usable = F.filter(D.subtree(nodes, main), lambda n: n["tag"].isin(*wanted) & ~n["noise"]
                      & ~(n["tag"].isin("ul", "ol") & (n["inside"].bitwiseAND(F.lit(UL | OL)) != 0)))
    return F.flatten(F.transform(usable, lambda n: F.when(n["tag"].isin("ul", "ol"), list_items(n))
                                 .otherwise(single(n))))


def waste_sections(pages: DataFrame, key: str = "page_id", topic: str = "topic") -> DataFrame:
    """(key, section_pos, sub, heading_path, block_type, text) of waste guide pages, tables expanded.

    ``pages`` needs ``nodes``, ``main`` and a topic column that starts every heading path.
    """
    from gleaner.operators.tables import table_sections

    nodes = F.col("nodes")
    items = unnest(pages, [key, topic], _waste_items(nodes, F.col("main")), "pos")
    tag, text = F.col("tag"), F.col("text")
    is_title = tag.isin("strong", "dt", *_HEADINGS)
    is_block = tag.isin("p", "div")
    block_lines = T.lines(T.clean_block_waste(text))
    list_heading = (tag == "li") & (F.col("direct") != "") & (F.col("has_child") | F.col("has_table")) \
        & P.looks_like_waste_heading(F.col("direct"))
    block_heading = is_block & ~F.col("has_table") & (F.size(block_lines) == 1) \
        & P.looks_like_waste_heading(F.get(block_lines, F.lit(0)))
    title = (
        F.when(is_title & P.looks_like_waste_heading(text), T.clean_inline(text))
        .when(list_heading, F.col("direct")).when(block_heading, F.get(block_lines, F.lit(0)))
    )
    items = items.withColumn("list_heading", list_heading).withColumn("block_heading", block_heading) \
        .withColumn("title", title)
    level = F.when(
        F.col("title").isNotNull() & ~P.is_bad_heading(F.col("title"), F.col(topic)),
        F.when(tag == "li", 5).otherwise(_level(tag)),
    )
    running = Window.partitionBy(key).orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    numbered = items.withColumn("level", level).withColumn("seq", F.row_number().over(running).cast("bigint"))
    runs = F.sum(F.when((tag == "li") & ~F.col("list_heading"), 0).otherwise(1)).over(running)
    placed = numbered.select(
        key, topic, "pos", "sub", "tag", "text", "direct", "child", "has_table", "list_heading", "block_heading",
        runs.alias("run"),
        heading_path(F.col("level"), F.col("title"), F.col("seq"), running, root=F.col(topic)).alias("path"),
    )
    pending = (tag == "li") & ~F.col("list_heading") & ~F.col("has_table")
    own = (
        F.when(F.col("list_heading"), F.col("child"))
        .when(pending | (is_block & ~F.col("has_table") & ~F.col("block_heading")), T.clean_block_waste(text))
        .when(tag == "dl", text)
    )
    kind = F.when(tag == "li", "list").when(tag == "dl", "definition_list").otherwise("paragraph")
    loose = placed.where(~tag.isin("table", "strong", "dt", *_HEADINGS)).select(
        key, "pos", "sub", "run", F.col("list_heading").alias("headed"), "path", kind.alias("block_type"),
        own.alias("raw")).where("raw <> ''")
    parts = F.array_sort(F.collect_list(F.struct("sub", "raw")))
    joined = loose.groupBy(key, "pos", "run", "headed", "block_type").agg(
        F.min("sub").alias("sub"), F.min("path").alias("heading_path"),
        F.array_join(F.transform(parts, lambda x: x["raw"]), "\n").alias("raw"),
    )
    cleaned = F.struct(T.clean_text(T.clean_block_waste(F.col("raw")), trailing_blanks=False).alias("text"))
    texts = unnest(joined.withColumnRenamed("pos", "section_pos"), [key, "section_pos", "sub", "heading_path", "block_type"],
                   F.filter(F.array(cleaned), lambda s: s["text"] != ""), "text")
    base = F.when(F.col("direct") != "", F.array(F.col(topic), F.col("direct"))).otherwise(F.col("path"))
    tables = table_sections(placed.where(tag == "table").select(key, "pos", base.alias("base")), pages, key)
    return first_of(texts.unionByName(tables), [key, "heading_path", "block_type", "text"], ["section_pos", "sub"])
