"""Page snapshots and their node tables.

One narrow Arrow stage turns html into a flat list of nodes in document order; every rule after it is
a column expression or a DataFrame operation. ``pos`` is a node's place in the list and ``last`` the
place of its last descendant, so the subtree of a node is one ``slice`` of the list.

The strings of a page are kept once, as two texts in the first node (``page``): the strings outside noise and all strings, one
per line. Every node has the stretch of both that its descendants take, so the text of a node is one
substring and not a look at all its descendants. ``inside`` has a bit per kind of structure around a node, and four bits
further up the same for what is around its parent.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from gleaner import lexicon as lx
from gleaner.session import spread

NODE = t.StructType([
    t.StructField("pos", t.IntegerType()),
    t.StructField("last", t.IntegerType()),
    t.StructField("parent", t.IntegerType()),
    t.StructField("li", t.IntegerType()),
    t.StructField("tag", t.StringType()),
    t.StructField("inside", t.IntegerType()),
    t.StructField("text", t.StringType()),
    t.StructField("attrs", t.MapType(t.StringType(), t.StringType())),
    t.StructField("noise", t.BooleanType()),
    t.StructField("names", t.ArrayType(t.StringType())),
    t.StructField("start", t.IntegerType()),
    t.StructField("end", t.IntegerType()),
    t.StructField("all_start", t.IntegerType()),
    t.StructField("all_end", t.IntegerType()),
    t.StructField("page", t.StructType([t.StructField("visible", t.StringType()), t.StructField("every", t.StringType())])),
])

# bits of ``inside``
UL, OL, TABLE, DL = 1, 2, 4, 8
_ABOVE = 4
ABOVE = 15 << _ABOVE
_STRUCTURES = {"ul": UL, "ol": OL, "table": TABLE, "dl": DL}

_VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command "
    "frame image isindex nextid spacer".split()
)

# Plain markup, which every version of the parser reads alike: text and then a start tag, an end tag, a comment, a
# doctype or the end. A page that holds anything else goes through the parser.
_PLAIN = re.compile(
    r"""([^<]*+)(?:<([a-z][a-z0-9]*+)((?:[ \t\n\r\f]++[a-z_][a-z0-9_:.-]*+(?:=(?:"[^"&<>]*+"|'[^'&<>]*+'|[a-z0-9_.:#,%-]++))?+)*+)[ \t\n\r\f]*+>"""
    r"""|</([a-z][a-z0-9]*+)>|<!--([^<>-]*+(?:-[^<>-]++)*+)-->|(<!doctype[^<>]*+>)|\Z)""", re.ASCII | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([a-z_][a-z0-9_:.-]*+)(?:="([^"]*+)"|='([^']*+)'|=([^ \t\n\r\f]++))?+""", re.ASCII | re.IGNORECASE)
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())  # their content is no markup


def _plain_tokens(html: str) -> list[tuple] | None:
    """(text before it, start tag, attributes, end tag, comment, doctype) of each piece of markup, or None if a piece is not plain."""
    tokens, at, raw = [], 0, ""
    match = _PLAIN.match
    while at < len(html):
        found = match(html, at)
        if found is None:
            return None
        token = text, tag, _, end, _, _ = found.groups()
        if raw:
            if "&" in text or not end or end.lower() != raw:
                return None
            raw = ""
        elif tag and tag.lower() in _RAW:
            raw = tag.lower()
        tokens.append(token)
        at = found.end()
    return None if raw else tokens


class _Nodes(HTMLParser):
    """Collects nodes; an end tag closes the nearest open element of its name or nothing."""

    def __init__(self, noise):
        super().__init__(convert_charrefs=True)
        self.noise = noise
        self.rows = []  # in the order of NODE
        self.open = []
        self.pending = []
        self.visible, self.every = [], []  # strings
        self.at, self.all_at = 0, 0  # where the next one starts

    def updatepos(self, i, j):
        return j  # lines are not counted

    def _add(self, tag, text, attrs=(), names=()):
        pos = len(self.rows)
        up = self.rows[self.open[-1]] if self.open else None
        li = -1 if up is None else (up[0] if up[4] == "li" else up[3])
        inside = 0 if up is None else up[5] & 15 | _STRUCTURES.get(up[4], 0) | (up[5] & 15) << _ABOVE
        noisy = not self.noise.isdisjoint(names) or bool(up and up[8])
        self.rows.append([pos, pos, up[0] if up else -1, li, tag, inside, text, attrs, noisy, names,
                          self.at, self.at, self.all_at, self.all_at, None])
        if tag == "#text":
            self.every.append(text)
            self.all_at += len(text) + 1
            if not noisy:
                self.visible.append(text)
                self.at += len(text) + 1
        return pos

    def _flush(self):
        if not self.pending:
            return
        text = "".join(self.pending).strip()
        self.pending = []
        if text:
            hidden = bool(self.open) and self.rows[self.open[-1]][4] in ("script", "style", "template")
            self._add("#hidden" if hidden else "#text", text)

    def _close(self, depth):
        last = len(self.rows) - 1
        for pos in self.open[depth:]:
            row = self.rows[pos]
            row[1] = last
            row[11], row[13] = max(self.at - 1, row[10]), max(self.all_at - 1, row[12])
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self._flush()
        names = [tag]
        if attrs:
            attrs = {k: v or "" for k, v in attrs}
            names += ["." + c for c in attrs.get("class", "").split()]
            if attrs.get("id"):
                names.append("#" + attrs["id"])
            attrs = list(attrs.items())
        pos = self._add(tag, None, attrs, names)
        if tag not in _VOID:
            self.open.append(pos)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[depth]][4] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("#comment", data)

    def read(self, tokens):
        for text, tag, attrs, end, comment, _ in tokens:
            if text:
                self.pending.append(unescape(text) if "&" in text else text)
            if tag:
                self.handle_starttag(tag.lower(), [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attrs)] if attrs else [])
            elif end:
                self.handle_endtag(end.lower())
            elif comment is not None:
                self.handle_comment(comment)

    def finish(self, html):
        tokens = _plain_tokens(html)
        if tokens is None:
            self.feed(html)
            self.close()
        else:
            self.read(tokens)
        self._flush()
        self._close(0)
        if self.rows:
            self.rows[0][14] = {"visible": "\n".join(self.visible), "every": "\n".join(self.every)}
        return self.rows


def _node_lists(pages: list[list[list]], node_type: pa.DataType) -> pa.Array:
    """The node lists of pages as one array, put together field by field."""
    rows = [row for page in pages for row in page]
    fields = [node_type.field(i) for i in range(node_type.num_fields)]
    values = zip(*rows, strict=True) if rows else [()] * len(fields)
    nodes = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, pages))], pa.int32()), nodes)


def with_nodes(pages: DataFrame, noise_selectors=lx.NOISE_SELECTORS, html: str = "html") -> DataFrame:
    """Replace the html column by ``nodes``, keeping the other columns."""
    kept = [c for c in pages.columns if c != html]
    schema = t.StructType([*(pages.schema[c] for c in kept), t.StructField("nodes", t.ArrayType(NODE))])
    noise = frozenset(noise_selectors)

    def tokenise(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        node_type = to_arrow_type(NODE)
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            texts = batch.column(batch.schema.get_field_index(html))
            # small output pieces: a page's nodes are several times its html
            for start in range(0, batch.num_rows, 64):
                part = texts.slice(start, 64).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, 64) for c in columns), _node_lists([_Nodes(noise).finish(page or "") for page in part], node_type)],
                    names=schema.names,
                )

    return spread(pages.select(*kept, html), rounds=8).mapInArrow(tokenise, schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshot (page_id, url, html) and optionally content_type, from parquet."""
    return spark.read.parquet(path)


def file_inventory(spark: SparkSession, folder: str, profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """``*.pdf`` files of a folder in any letter case, with title and document id; contents are not read."""
    from gleaner.functions import text as T

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
        .select("path", "length", "modificationTime")
    )
    name = F.try_url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    return files.select(
        T.file_doc_id(profile.passport_source, name).alias("doc_id"),
        name.alias("file_name"),
        T.filename_to_title(name).alias("title"),
        F.col("path").alias("file_path"),
        F.col("length").alias("n_bytes"),
    )
