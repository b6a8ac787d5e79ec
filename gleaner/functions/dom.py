"""Expressions over a page's node list (see ``gleaner.sources.pages``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as T


def subtree(nodes: Column, node: Column) -> Column:
    """Descendants in document order."""
    return F.slice(nodes, node["pos"] + 2, node["last"] - node["pos"])


def attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def has_tag(node: Column, *tags: str) -> Column:
    return node["tag"].isin(*tags)


def strings(nodes: Column, node: Column, keep_noise: bool = False) -> Column:
    """Stripped visible strings below a node."""
    found = F.filter(
        subtree(nodes, node),
        lambda n: (n["tag"] == "#text") if keep_noise else (n["tag"] == "#text") & ~n["noise"],
    )
    return F.transform(found, lambda n: n["text"])


def page_text(nodes: Column) -> Column:
    """All strings of a page, one per line."""
    return F.coalesce(F.get(nodes, F.lit(0))["page"]["every"], F.lit(""))


def line_text(nodes: Column, node: Column, keep_noise: bool = False) -> Column:
    """Visible strings below a node, one per line."""
    page = F.get(nodes, F.lit(0))["page"]
    if keep_noise:
        return F.substring(page["every"], node["all_start"] + 1, node["all_end"] - node["all_start"])
    return F.substring(page["visible"], node["start"] + 1, node["end"] - node["start"])


def flat_text(nodes: Column, node: Column, keep_noise: bool = False) -> Column:
    return T.clean_inline(line_text(nodes, node, keep_noise))


def direct_text(nodes: Column, node: Column) -> Column:
    """Own strings of a node without those of its children."""
    own = F.filter(
        subtree(nodes, node),
        lambda n: (n["parent"] == node["pos"]) & n["tag"].isin("#text", "#comment") & ~n["noise"],
    )
    return F.array_join(F.filter(F.transform(own, lambda n: T.clean_inline(n["text"])), lambda x: x != ""), " ")


def children(nodes: Column, node: Column, *tags: str) -> Column:
    return F.filter(
        subtree(nodes, node), lambda n: (n["parent"] == node["pos"]) & has_tag(n, *tags) & ~n["noise"]
    )


def descendants(nodes: Column, node: Column, *tags: str) -> Column:
    return F.filter(subtree(nodes, node), lambda n: has_tag(n, *tags) & ~n["noise"])


def matches(node: Column, selector: str) -> Column:
    """tag, #id or .class"""
    return F.array_contains(node["names"], selector)


def select(nodes: Column, selector: str) -> Column:
    """Nodes matching a selector (two parts mean "inside"), noise excluded."""
    *outer, inner = selector.split(" ")
    if not outer:
        return F.filter(nodes, lambda n: matches(n, inner) & ~n["noise"])
    hosts = select(nodes, outer[0])
    return F.flatten(F.transform(hosts, lambda h: F.filter(
        subtree(nodes, h), lambda n: matches(n, inner) & ~n["noise"])))


def first(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))
