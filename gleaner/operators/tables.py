"""Tables inside pages: dense cell grid, table kind, and one rule per kind."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import dom as D
from gleaner.functions import text as T
from gleaner.operators.bounds import unnest


@F.arrow_udf("array<array<string>>")
def fill_spans(tables: pa.Array) -> pa.Array:
    """Rows of (text, rowspan, colspan) cells to rows of texts, spanned places repeated."""

    def dense(rows):
        held, out = {}, []
        for r, cells in enumerate(rows):
            row = []

            def take_held(r=r, row=row):
                while (r, len(row)) in held:
                    row.append(held[r, len(row)])

            for cell in cells:
                take_held()
                for _ in range(cell["colspan"]):
                    for below in range(r + 1, min(r + cell["rowspan"], len(rows))):
                        held[below, len(row)] = cell["text"]
                    row.append(cell["text"])
            take_held()
            out.append(row)
        return out

    return pa.array([dense(rows or []) for rows in tables.to_pylist()], pa.list_(pa.list_(pa.string())))


def _span(cell: Column, name: str) -> Column:
    value = D.attr(cell, name).try_cast("int")
    return F.when(value > 0, value).otherwise(1)


def _grid_cells(nodes, rows, direct: bool, drop_blanks: bool) -> Column:
    def cells(row):
        found = D.children(nodes, row, "th", "td") if direct else D.descendants(nodes, row, "th", "td")

        def cell(c):
            text = D.flat_text(nodes, c)
            text = F.replace(text, F.lit(" "), F.lit("")) if drop_blanks else text
            return F.struct(text.alias("text"), _span(c, "rowspan").alias("rowspan"),
                            _span(c, "colspan").alias("colspan"))

        return F.transform(found, cell)

    return F.transform(rows, cells)


def page_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, pos, kind, and the cell views the rules below use) of each table in ``main``; a view no rule of the kind looks at is null."""
    nodes = F.col("nodes")

    def view(t):
        bodies = D.descendants(nodes, t, "tbody")
        body_rows = F.flatten(F.transform(bodies, lambda b: D.descendants(nodes, b, "tr")))
        first_body_rows = F.flatten(F.transform(F.slice(bodies, 1, 1), lambda b: D.children(nodes, b, "tr")))
        rows = D.descendants(nodes, t, "tr")

        def cells(r, text, *tags):
            return F.transform(D.children(nodes, r, *tags), lambda c: text(nodes, c))

        def head_cells():
            heads = F.flatten(F.transform(D.descendants(nodes, t, "thead"), lambda h: D.descendants(nodes, h, "tr")))
            return F.flatten(F.transform(heads, lambda r: F.transform(
                D.descendants(nodes, r, "th"), lambda c: D.flat_text(nodes, c))))

        def views(kind):
            return F.struct(
                t["pos"].cast("bigint").alias("pos"), kind.alias("kind"),
                F.when(kind == "weekday", head_cells()).alias("head"),
                F.when(kind == "company", F.transform(body_rows, lambda r: cells(r, D.flat_text, "td"))).alias("body_flat"),
                F.when(kind.isin("item_guide", "weekday", "item_guide_or_general"), F.transform(
                    body_rows, lambda r: cells(r, D.line_text, "td"))).alias("body_lines"),
                F.when(kind == "price", F.transform(
                    rows, lambda r: F.filter(cells(r, D.flat_text, "th", "td"), lambda x: x != ""))).alias("flat"),
                F.when(kind == "fee", _grid_cells(nodes, first_body_rows, True, False))
                .when(kind.isin("general", "item_guide_or_general"), _grid_cells(nodes, rows, False, True)).alias("cells"),
            )

        caption = D.first(D.descendants(nodes, t, "caption"))
        said = F.struct(F.coalesce(D.flat_text(nodes, caption), F.lit("")).alias("caption"), D.flat_text(nodes, t).alias("text"))
        return T.let(T.let(said, lambda x: table_kind(x["caption"], x["text"])), views)

    found = F.transform(D.descendants(nodes, F.col("main"), "table"), view)
    return unnest(pages, [key], found, "pos").withColumn("grid", fill_spans("cells")).drop("cells")


def table_kind(caption: Column, table_text: Column) -> Column:
    return (
        F.when(caption.contains("대형폐기물 수집 및 운반 처리 수수료"), "fee")
        .when(caption.contains("음식물쓰레기") & caption.contains("배출요령"), "item_guide")
        .when(caption.contains("쓰레기 배출요일"), "weekday")
        .when(caption.contains("수집 및 운반업체"), "company")
        .when(caption.contains("규격봉투 가격표"), "price")
        .when(caption.contains("음식물쓰레기 전용용기"), "price")
        .when(table_text.contains("품목") & table_text.contains("배출요령"), "item_guide_or_general")
        .otherwise("general")
    )


def _section(path: Column, block_type: str, text: Column) -> Column:
    return F.struct(path.alias("heading_path"), F.lit(block_type).alias("block_type"), text.alias("text"))


def _cell(row: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(row, F.lit(i + 1)), F.lit(""))


def _labelled(pairs) -> Column:
    parts = [x for label, value in pairs for x in (F.lit(f"{label}: "), value, F.lit("\n"))]
    return F.concat(*parts[:-1])


def fee_sections(base: Column, grid: Column) -> Column:
    """Rows of eight or more columns: type, -, item, -, size, total, collection, treatment."""
    wide = F.filter(grid, lambda r: (F.size(r) >= 8) & F.forall(F.array(*[_cell(r, i) for i in (0, 2, 4, 5)]),
                                                               lambda x: x != ""))
    return F.transform(wide, lambda r: _section(
        F.concat(base, F.array(_cell(r, 0), _cell(r, 2))), "table_row",
        _labelled([("품명", _cell(r, 2)), ("규격", _cell(r, 4)), ("수수료 계", _cell(r, 5)),
                   ("수집·운반비", _cell(r, 6)), ("처리비", _cell(r, 7))])))


def item_guide_sections(base: Column, rows: Column) -> Column:
    """Three columns: item, how to dispose of it, what must not go in."""
    root = F.coalesce(F.try_element_at(base, F.lit(1)), F.lit("음식물쓰레기 배출요령"))

    def both(r):
        item, guide, banned = T.clean_inline(_cell(r, 0)), T.clean_block_waste(_cell(r, 1)), \
            T.clean_block_waste(_cell(r, 2))
        return F.array(
            F.when((item != "") & (guide != ""), _section(F.array(root, F.lit("배출요령"), item), "table_row", guide)),
            F.when(banned != "", _section(F.array(root, F.lit("음식물 전용용기에 넣어서는 안되는 물질")), "table_row",
                                          banned)),
        )

    made = F.flatten(F.transform(F.filter(rows, lambda r: F.size(r) >= 3), both))
    return F.filter(made, lambda s: s.isNotNull())


def weekday_sections(base: Column, head: Column, rows: Column) -> Column:
    """Header days zipped with the first body row."""
    values = F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>"))

    def after_first(a):
        return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))

    made = F.zip_with(after_first(head), after_first(values), lambda day, cell: F.struct(
        day.alias("day"), T.clean_block_waste(cell).alias("text")))
    usable = F.filter(made, lambda x: (F.coalesce(x["day"], F.lit("")) != "") & (x["text"] != ""))
    return F.transform(usable, lambda x: _section(F.concat(base, F.array(F.lit("쓰레기 배출요일"), x["day"])), "table_row",
                                                  x["text"]))


def company_sections(base: Column, rows: Column) -> Column:
    return F.transform(F.filter(rows, lambda r: F.size(r) >= 3), lambda r: _section(
        F.concat(base, F.array(_cell(r, 0))), "table_row",
        _labelled([("담당구역", _cell(r, 1)), ("전화번호", _cell(r, 2))])))


def price_sections(base: Column, rows: Column, spec_label: str = "용기규격") -> Column:
    """Unpivot: one section per column, the spec row (if any) joins the heading."""
    filled = F.filter(rows, lambda r: F.size(r) > 0)
    body = F.filter(F.slice(filled, F.lit(2), F.size(filled)), lambda r: F.size(r) >= 2)
    # a repeated row label keeps its first place and its last values
    labels = F.array_distinct(F.transform(body, lambda r: r[0]))
    chosen = F.transform(labels, lambda name: F.try_element_at(F.filter(body, lambda r: r[0] == name), F.lit(-1)))
    specs = D.first(F.filter(chosen, lambda r: r[0] == spec_label))
    header = D.first(filled)

    def value(row, i):
        return F.coalesce(F.try_element_at(row, i + 1), F.lit(""))

    def column(i):
        cells = F.filter(chosen, lambda r: (r[0] != spec_label) & (value(r, i) != ""))
        text = F.array_join(F.transform(cells, lambda r: F.concat(r[0], F.lit(": "), value(r, i))), "\n")
        spec = value(specs, i)
        tail = F.when(spec != "", F.array(value(header, i), spec)).otherwise(F.array(value(header, i)))
        return _section(F.concat(base, tail), "table_column", text)

    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(header) - 1, F.lit(1))), column)
    kept = F.filter(made, lambda s: (s["text"] != "") & (F.try_element_at(s["heading_path"], F.size(base) + 1) != ""))
    return F.when(F.size(filled) >= 2, kept)


def general_sections(base: Column, grid: Column, header_words=lx.TABLE_HEADER_WORDS) -> Column:
    """Three or more cells: two-level path and the rest; two cells: one-level path."""
    rows = F.transform(grid, lambda r: F.filter(r, lambda x: (x != "") & ~x.isin(*header_words)))

    def made(r):
        rest = T.strip(F.array_join(F.slice(r, F.lit(3), F.greatest(F.size(r) - 2, F.lit(0))), " "))
        return F.when(F.size(r) >= 3, _section(F.concat(base, F.slice(r, 1, 2)), "table_row", rest)).otherwise(
            _section(F.concat(base, F.slice(r, 1, 1)), "table_row", _cell(r, 1)))

    return F.transform(F.filter(rows, lambda r: F.size(r) >= 2), made)


def table_sections(bases: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Sections of every table, given (key, pos, base path) rows for them."""
    tables = page_tables(pages, key).join(bases, [key, "pos"])
    base = F.col("base")
    guide = item_guide_sections(base, F.col("body_lines"))
    general = general_sections(base, F.col("grid"))
    rules = (
        F.when(F.col("kind") == "fee", fee_sections(base, F.col("grid")))
        .when(F.col("kind") == "item_guide", guide)
        .when(F.col("kind") == "weekday", weekday_sections(base, F.col("head"), F.col("body_lines")))
        .when(F.col("kind") == "company", company_sections(base, F.col("body_flat")))
        .when(F.col("kind") == "price", price_sections(base, F.col("flat")))
        .when((F.col("kind") == "item_guide_or_general") & (F.size(guide) > 0), guide)
        .otherwise(general)
    )
    made = tables.select(key, F.col("pos").alias("section_pos"), F.posexplode_outer(rules)) \
        .where("pos is not null")
    return made.select(key, "section_pos", F.col("pos").alias("sub"), "col.heading_path", "col.block_type",
                       "col.text")
