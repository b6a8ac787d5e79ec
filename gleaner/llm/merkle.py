"""Merkle manifest of a table: content-addressed records, and proofs by descent from the root.

Leaves are the rows, ordered within a tree (say, one source). While a tree has more than one node, every ``FANOUT``
consecutive nodes become the children of one record, which is stored under its own digest: (digest -> children).
The subroots of all trees are the leaves of one more tree, whose last node is the root.

Proofs are found by descent. All requests start together at the root; at each record the next digit of a request's
rank (base ``FANOUT``, most significant first) selects a child, and what lies left and right of it is one segment of
the path. Requests that share digits share the state, so a level of the descent has one row per node and not per
request. At the leaf the segments are reversed: folding starts there.

No step holds a whole tree: ranks come from a range-partitioned order with counts per partition, records are groups
of at most ``FANOUT`` rows, and every join has a key of one record.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import ranked
from gleaner.session import written

FANOUT = 16
_EDGE = ("tree", "rank", "digest")


def digest_of(*digests: Column) -> Column:
    """SHA-256 of digests (hexadecimal text) one after the other, as hexadecimal text."""
    return F.sha2(F.concat(*digests), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 length, a colon and the value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest_of(*map(framed, values))


def tree_name(column: Column) -> Column:
    """A never-null text that orders like the column: null first, then by UTF-8 bytes."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), column.cast("string")))


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves: the least h with FANOUT ** h >= n."""
    return reduce(add, [(n > F.lit(FANOUT ** i)).cast("int") for i in range(15)])


def _grouped(nodes: DataFrame, *more: str) -> DataFrame:
    """Runs of FANOUT consecutive nodes of each tree: new rank and the run in order."""
    run = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("place"), "digest", *more)))
    return nodes.groupBy("tree", F.expr(f"rank div {FANOUT}").alias("slot")).agg(F.max("n").alias("n"), run.alias("run")).select(
        "tree", F.col("slot").alias("rank"), "n", "run", F.col("run.digest").alias("children"))


def _levels(records: DataFrame, tallest: int, at: int, label: str) -> list[DataFrame]:
    """Records of the levels ``at + 1`` to ``tallest`` above ``records``, the records of level ``at``."""
    out = []
    for level in range(at + 1, tallest + 1):
        nodes = (out[-1] if out else records).where(height(F.col("n")) >= level).select("tree", "rank", "n", "digest")
        out.append(written(_grouped(nodes).select(
            "tree", "rank", "n", digest_of(F.array_join("children", "")).alias("digest"), "children"), f"{label}-{level}"))
    return out


@dataclass
class Manifest:
    """``bundles``: the lowest records with their leaves (``run``: place, digest and carried columns);
    ``records``: digest -> children by level from 2 up; ``subroots``: one row per tree with its rank; ``top``:
    records above the subroots by level from 1 up; ``root``: the root's digest, None for an empty table."""

    bundles: DataFrame
    records: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None

    def leaves(self) -> DataFrame:
        """Every leaf: tree, rank, digest and the carried columns."""
        return self.bundles.select("tree", F.inline("run")).withColumnRenamed("place", "rank")


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """Manifest of a written table with the columns ``tree`` (text, never null), ``digest`` and any others.

    Leaves of a tree ascend by ``order`` (nulls first), ties by digest; equal rows are leaves of their own.
    An empty table has no root.
    """
    carried = [c for c in leaves.columns if c not in ("tree", "digest")]
    runs = _grouped(ranked(leaves, [*order, "digest"]), *carried)
    lone = F.col("n") == 1
    bundles = written(runs.withColumn("digest", F.when(lone, F.col("children")[0]).otherwise(
        digest_of(F.array_join("children", "")))), "manifest-leaves")
    tallest = bundles.agg(F.max(height(F.col("n")))).first()[0]
    if tallest is None:
        return Manifest(bundles, [], bundles.select("tree", "n", "digest").withColumn("rank", F.lit(0).cast("long")), [], None)
    records = _levels(bundles, tallest, 1, "manifest-records")
    low = height(F.col("n")) <= 1
    roots = reduce(DataFrame.unionByName, [bundles.where(low).select("tree", "n", "digest")] + [
        r.where(height(F.col("n")) == level).select("tree", "n", "digest") for level, r in enumerate(records, 2)])
    places = written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("size"), "digest"), "manifest-trees")
    subroots = written(ranked(places, ["name"]), "manifest-subroots")
    trees = subroots.agg(F.max(height(F.col("n")))).first()[0]
    top = _levels(subroots, trees, 0, "manifest-top")
    root = (top[-1] if top else subroots).select("digest").first()[0]
    return Manifest(bundles, records, subroots.select(F.col("name").alias("tree"), F.col("size").alias("n"), "digest", "rank"), top, root)


def _segment(children: Column, place: Column) -> Column:
    """What lies left and right of the selected child."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), place), "").alias("lft"),
                    F.array_join(F.slice(children, place + 2, F.lit(FANOUT)), "").alias("rgt"))


def _down(states: DataFrame, records: DataFrame, *keep: str) -> DataFrame:
    """States of the children of the records that the states have reached."""
    met = states.join(records.select(*_EDGE, "children"), list(_EDGE))
    return met.select("*", F.posexplode("children").alias("place", "child")).select(
        "tree", (F.col("rank") * FANOUT + F.col("place")).alias("rank"), F.col("child").alias("digest"),
        F.array_append("path", _segment(F.col("children"), F.col("place"))).alias("path"), *keep)


def proofs(made: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """Per requested leaf: tree, rank, digest, carried columns, ``subroot`` and ``path``, its segments from the leaf up.

    ``asked`` holds the requested leaves (tree, rank); without it all leaves are requested. A request for a leaf that
    does not exist gives no row. Segments are (lft, rgt): the digests beside the node of that level, joined.
    """
    def wanted(states: DataFrame, level: int) -> DataFrame:
        if asked is None:
            return states
        keys = asked.select("tree", F.expr(f"rank div {FANOUT ** level}L").alias("rank")).distinct()
        return states.join(keys, ["tree", "rank"], "left_semi")

    none = F.array().cast("array<struct<lft:string,rgt:string>>")
    # the one row that holds the root: the last record above the subroots, or the only subroot
    states = (made.top[-1] if made.top else made.subroots.select(F.lit("").alias("tree"), "rank", "digest")).select(*_EDGE, none.alias("path"))
    for records in reversed(made.top):
        states = _down(states, records)
    starts = states.select("rank", "digest", "path").join(made.subroots, ["rank", "digest"]).select(
        "tree", F.lit(0).cast("long").alias("rank"), "digest", "path", F.col("digest").alias("subroot"), "n")
    if asked is not None:
        starts = starts.join(asked.select("tree").distinct(), "tree", "left_semi")
    states = None
    for level in range(len(made.records) + 1, 0, -1):
        tall = height(F.col("n"))
        here = starts.where(tall == level if level > 1 else tall <= 1)
        states = wanted(here if states is None else states.unionByName(here), level)
        if level > 1:
            states = _down(states, made.records[level - 2], "subroot", "n")
    met = states.drop("n").join(made.bundles, list(_EDGE)).select(
        "tree", "children", "n", "path", "subroot", F.posexplode("run").alias("place", "leaf"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.array_append("path", _segment(F.col("children"), F.col("place"))))
    leaves = met.select("tree", F.col("leaf.place").alias("rank"), "leaf", "subroot", F.reverse(path).alias("path"))
    return wanted(leaves, 0).select("tree", "rank", "subroot", "path", *(
        F.col(f"leaf.{c}").alias(c) for c in made.bundles.schema["run"].dataType.elementType.names if c != "place"))


def folded(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf's digest and its path."""
    return F.aggregate(path, leaf, lambda node, s: digest_of(s["lft"], node, s["rgt"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["lft"], s["rgt"])), ""), 256)
