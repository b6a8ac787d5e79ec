"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same number of times, target / source size, mostly not a whole number. The
whole part is given to all; the fractions are rounded so that the words taken stay on target: two documents with
fractions p and q meet, words are moved from one to the other - at random, with each fraction kept in expectation -
until one of them is 0 or 1, and the other meets the next document. What is left of a block of documents is one
document with a fraction; blocks' left-overs meet the same way in further levels until one per source is left, which
is drawn. Words only move, so a source misses its target by less than one document.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import free_names, numbered
from gleaner.session import written

WEIGHTS = (5.0, 2.0, 1.0)
_SURE = 1e-12


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict, weights=WEIGHTS, most: float = 3.0, share: float = 1.0) -> dict:
    """Target size per source: ``share`` of all sizes by weight, none above ``most`` times its source's size.

    ``weights`` repeat over the sources in code point order, null last; what a full source can't take is shared
    again by weight among the others.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets = dict.fromkeys(names, 0.0)
    open_, rest = [s for s in names if sizes[s] > 0], share * float(sum(sizes.values()))
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            targets |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            rest -= targets[s]
        open_ = [s for s in open_ if s not in full]
    return targets


def _draw(seed: int, *key) -> float:
    """Uniform in [0, 1) from the documents that meet, the same in every run."""
    return xxhash.xxh3_64_intdigest(repr(key).encode(), seed=seed) / 2.0**64


def pivot(rows: list[tuple], seed: int) -> tuple[list[int], tuple | None]:
    """Round fractions of rows (name, size, fraction): 0 or 1 each, and the row left over (index, fraction), if any.

    Sizes are positive. If p is moved by +a words or -b words with probabilities b/(a+b) and a/(a+b),
    both fractions keep their expectation and the words of the pair their sum.
    """
    out = [0] * len(rows)
    held = None
    for i, (name, size, fraction) in enumerate(rows):
        if fraction <= _SURE or fraction >= 1 - _SURE:
            out[i] = int(fraction > 0.5)
            continue
        if held is None:
            held = (i, fraction)
            continue
        j, p = held
        other, wide = rows[j][0], rows[j][1]
        up = min((1 - p) * wide, fraction * size)  # words that can go to the held row
        down = min(p * wide, (1 - fraction) * size)
        moved = up if _draw(seed, other, name) * (up + down) < down else -down
        p, q = p + moved / wide, fraction - moved / size
        rest = [(k, f) for k, f in ((j, p), (i, q)) if _SURE < f < 1 - _SURE]
        for k, f in ((j, p), (i, q)):
            out[k] = int(f > 0.5)
        held = rest[0] if rest else None
    return out, held


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
          most: int = 3, share: float = 1.0, seed: int = 17, block: int = 2048, fan_in: int = 256,
          most_sources: int = 100_000) -> DataFrame:
    """Per row: doc_id, key and key2 (hashes of id, text and source), number (among rows alike in them), source, size, source_size, target of the source, copies.

    Size is the number of words (null: 0). Rows without words and all rows of sources without words get 0 copies; a null
    source is a source; rows alike in every used column are rounded one by one and may get different copies; null ids
    count as an id. No row gets more than ``most`` copies. An empty table gives an empty one. The driver
    gives each of at most ``most_sources`` sources its target; blocks hold about ``block`` rows, whatever a source holds and however many
    rows are alike.
    """
    spark = docs.sparkSession
    rows = written(docs.select(docs[doc_id].alias("doc_id"), *_keys(doc_id, text, source), docs[source].alias("source"),
                               word_count(text).alias("size")), "sizes")
    rows = numbered(rows, ["key", "key2"], "number")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")).limit(
        most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources; group them first")
    sizes = {r["source"]: r["source_size"] for r in sums}
    targets = source_targets(sizes, weights, most, share)
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], targets[r["source"]], max(1, -(-r["n_rows"] // block))) for r in sums],
        "plan_source string, source_size long, target double, blocks long")
    # one row per source
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + _SURE).cast("long")
    rows = (rows.withColumn("copies", whole).withColumn("fraction", F.greatest(ratio - whole, F.lit(0.0)))
            .withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed), "number"), F.col("blocks")))
            .drop("blocks"))
    schema = T.StructType([*rows.schema.fields, T.StructField("open", T.BooleanType(), False)])

    def level(number: int):
        def round_block(table: pa.Table) -> pa.Table:
            sizes, names = table.column("size").to_pylist(), list(zip(*(table.column(c).to_pylist() for c in ("key", "key2", "number"))))
            order = sorted(range(len(names)), key=lambda i: (-sizes[i], names[i]))  # alike sizes meet
            table = table.take(pa.array(order, pa.int64()))
            fraction = table.column("fraction").to_pylist()
            named = [(names[i], sizes[i], fraction[k]) for k, i in enumerate(order)]
            given, left = pivot(named, seed + number)
            fractions, still = [0.0] * len(order), [False] * len(order)
            if left is not None:
                given[left[0]], fractions[left[0]], still[left[0]] = 0, left[1], True
            columns = {n: table.column(n) for n in table.column_names if n != "open"}
            columns["copies"] = pa.compute.add(table.column("copies"), pa.array(given, pa.int64()))
            columns["fraction"], columns["open"] = pa.array(fractions), pa.array(still)
            return pa.table([columns[f.name] for f in schema.fields], names=schema.names)

        return round_block

    names = [f.name for f in schema.fields]
    sure = (F.col("fraction") <= _SURE) | (F.col("fraction") >= 1 - _SURE)
    done = [rows.where(sure).withColumn("copies", F.col("copies") + F.when(F.col("fraction") > 0.5, 1).otherwise(0))
            .withColumn("open", F.lit(False)).select(names)]
    work, number = rows.where(~sure), 0
    blocks = max((-(-r["n_rows"] // block) for r in sums), default=0)
    while blocks:
        made = written(work.groupBy("source", "block").applyInArrow(level(number), schema), f"rounded-{number}")
        done.append(made.where(~F.col("open")))
        if blocks == 1:
            last = made.where("open")
            draw = F.pmod(F.xxhash64("key", F.lit(seed), F.lit("last"), "number"), F.lit(1 << 53)) / float(1 << 53)
            done.append(last.withColumn("copies", F.col("copies") + (draw < F.col("fraction")).cast("long")))
            break
        # the left-overs of all blocks, at most one each, meet in blocks of the next level
        blocks, number = -(-blocks // fan_in), number + 1
        work = made.where("open").withColumn("block", F.pmod("block", F.lit(blocks))).drop("open")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "key", "key2", "number", "source", "size", "source_size", "target", "copies")


def _keys(doc_id: str, text: str, source: str) -> list[Column]:
    """128 bits that name a row; rows alike in id, text and source have the same."""
    used = [F.col(doc_id), F.col(text), F.col(source)]
    flags = [c.isNull() for c in used]
    return [F.xxhash64(*used, *flags).alias("key"), F.xxhash64(F.lit(1), *flags, *used).alias("key2")]


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was drawn."""
    # columns of any name travel in one struct; rows alike are told apart by a number
    left = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), *_keys(doc_id, text, source))
    left = numbered(left, ["key", "key2"], "number")
    drawn = mixed(docs, doc_id, text, source, **settings).where("copies > 0").select("key", "key2", "number", "copies")
    copy, = free_names(docs, "copy")
    both = left.join(drawn, ["key", "key2", "number"])
    return both.select("whole.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(copy)).drop(copy)
