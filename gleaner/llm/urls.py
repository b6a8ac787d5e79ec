"""URL rules: a blocked Bloom filter of the listed keys in front of an exact hash join.

A rule names a host with all its subdomains and a beginning of the path. A url is looked up under every host suffix and every
path length that rules have; keys that the filter does not hold never leave their task, the others meet the rule
table in an exact join, which removes the filter's false hits. The longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import build_bloom, shared


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://`` or for null."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Rules as (key, rule, verdict) with the longest first wins order in ``size``.

    ``rules`` has rule (host and path, such as ``example.com/en/``) and verdict. Hosts are lower-cased, a rule without ``/``
    gets one. Rules without host and rules with null are left out; of equal rules with different verdicts
    block wins.
    """
    text = F.when(F.instr("rule", "/") > 0, F.col("rule")).otherwise(F.concat("rule", F.lit("/")))
    host = _lower(F.substring_index(text, "/", 1))
    path = F.substring(text, F.length(host) + 1, F.length(text))
    listed = rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select(
        host.alias("host"), path.alias("path"), "verdict")
    return (listed.where("host != ''").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
            .select(F.concat("host", "path").alias("key"), F.length("path").alias("path_size"),
                    F.when(F.col("block"), "block").otherwise("allow").alias("verdict")))


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow",
           log2_blocks: int = 17, most_lengths: int = 4096) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict (the rule's; a url on no list gets ``default``).

    Rows are judged by their url, so null ids and repeated rows don't matter; null urls and urls without ``://`` have empty host
    and path and fit no rule; other columns are not looked at; empty tables of pages or rules are fine.
    Up to ``most_lengths`` different path lengths of rules are told to every task; if there are more, all beginnings of a path are tried.
    """
    spark = pages.sparkSession
    listed = canonical_rules(rules)
    lengths = [r[0] for r in listed.select("path_size").distinct().limit(most_lengths + 1).collect()]
    bloom = shared(spark, build_bloom(listed.select(F.xxhash64("key").alias("h")), "h", log2_blocks))
    host, path = host_and_path(url)
    page_rows = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    # each different url is looked up once, however many pages share it
    asked = page_rows.select("host", "path").distinct().where("host != ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if len(lengths) > most_lengths:
        sizes = F.when(F.length("path") > 0, F.sequence(F.lit(1), F.length("path"))).otherwise(F.array().cast("array<int>"))
    else:
        sizes = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"),
                         lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    tried = asked.select("host", "path", F.explode(keys).alias("key")).withColumn("h", F.xxhash64("key"))

    def sieve(batches):
        import pyarrow as pa

        for part in batches:
            if part.num_rows:
                hit = bloom.value.holds(part.column("h").to_numpy().view("uint64"))
                yield part.filter(pa.array(hit))

    possible = tried.mapInArrow(sieve, tried.schema)
    fitting = possible.drop("h").join(listed.select("key", "verdict"), "key")
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("size"), F.col("key").alias("rule"), "verdict")).alias("best"))
    out = page_rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


