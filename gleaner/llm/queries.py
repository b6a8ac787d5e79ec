"""The dealt operators as queries over the given tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, collocations, contamination, language, merkle, mixing, neardup, neighbours, privacy, substrings, tokens, toxicity, urls
from gleaner.llm.common import held_out, small_batches
from gleaner.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
          ("block", "net/fr/")]


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return privacy.personal_spans(_table(spark, sf_dir, "documents"))


@query
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest fitting rule on every page's url; a url on no list is allowed."""
    rules = spark.createDataFrame(_RULES, "verdict string, rule string")
    return urls.judged(_table(spark, sf_dir, "pages"), rules)


@query
def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage similar to a benchmark item, with each such item and its best similarity."""
    found = contamination.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity")


@query
def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its earlier seen 100-byte strings."""
    return substrings.without_repeats(_table(spark, sf_dir, "documents"), kept=False)


@query
def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 5-word shingles at 85 percent."""
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=5, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and where its first 1024 tokens end."""
    counted = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  budgets=(1024,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "fits_1024")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.profiles(docs, ~held_out("doc_id", 3, 1))
    return language.predicted(docs.select("doc_id", "text"), known).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by source: every row's proof, and the root folded from possibly tampered rows."""
    docs = _table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = written(docs.select(
        merkle.tree_name(F.col("source")).alias("tree"), "doc_id", merkle.leaf_digest(*head, F.col("text")).alias("digest"),
        F.when(held_out("doc_id", 5, 0), merkle.leaf_digest(*head, lowered)).alias("changed")), "manifest-rows")
    made = merkle.manifest(leaves, ["doc_id"])
    presented = F.coalesce("changed", "digest")
    root = F.lit(made.root)
    return merkle.proofs(made).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(presented, F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == root)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of 2 to 5 words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the tokenization automaton and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.decoded(bpe.encoded(_table(spark, sf_dir, "documents"), path), path)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


SQL["op3_url_rules"] = """
WITH rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'),
    ('block', 'net/es/'), ('block', 'net/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
keyed AS (SELECT row_number() OVER () AS i, * FROM parts),
fit AS (SELECT i, rule, verdict, row_number() OVER (PARTITION BY i ORDER BY length(rule) DESC) AS place FROM keyed JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM keyed LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (i)
"""

SQL["op7_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
    d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _merkle_sql(levels: int = 5) -> str:
    """Trees of up to 16 ** levels leaves; per level the nodes with what lies left and right of them in their run."""
    def beside(name, source):
        run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
        return (f"{name} AS (SELECT tree, i, digest, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, "
                f"coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt, "
                f"count(*) OVER (PARTITION BY tree) AS n FROM {source})")

    def above(name):
        return f"(SELECT tree, i // 16 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name} WHERE n > 1 GROUP BY 1, 2)"

    # fixed values: the polynomial of crc32
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), "
           "lambda a, c: list_reduce(list_concat([xor(a, c)], range(8)), lambda v, j: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)")
    columns = "doc_id, source, lang, n_chars".split(", ")
    framed = {c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in [*columns, "text"]}
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(framed[c] for c in columns)
    ctes = [f"d AS (SELECT row_number() OVER () AS k, doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, "
            f"sha256({head} || {framed['text']}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {framed['text'].replace('ELSE strlen(text::VARCHAR)', f'ELSE strlen({lowered})').replace('|| text', f'|| {lowered}')}) END AS changed FROM documents)",
            "e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
            beside("l0", "(SELECT tree, i, leaf AS digest FROM e)")]
    ctes += [beside(f"l{j}", above(f"l{j - 1}")) for j in range(1, levels + 1)]
    subroots = " UNION ALL ".join(f"SELECT tree, digest FROM l{j} WHERE n = 1" for j in range(levels + 1))
    ctes += [f"s AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS p FROM ({subroots}))", beside("t0", "(SELECT '' AS tree, p AS i, digest FROM s)")]
    ctes += [beside(f"t{j}", above(f"t{j - 1}")) for j in range(1, levels + 1)]
    ctes.append("r AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM t{j} WHERE n = 1" for j in range(levels + 1)) + ")")
    steps = [f"l{j}" for j in range(levels)] + [f"t{j}" for j in range(levels)]
    joins = " ".join([f"LEFT JOIN l{j} ON l{j}.n > 1 AND l{j}.tree = e.tree AND l{j}.i = e.i // {16 ** j}" for j in range(levels)]
                     + [f"LEFT JOIN t{j} ON t{j}.n > 1 AND t{j}.i = s.p // {16 ** j}" for j in range(levels)])
    proof = " || ".join(f"coalesce({t}.lft || {t}.rgt, '')" for t in steps)
    fields = ", ".join(f"{t}.lft AS {t}l, {t}.rgt AS {t}r" for t in steps)
    ctes.append(f"f0 AS (SELECT e.k, doc_id, leaf, s.digest AS subroot, root, sha256({proof}) AS proof_sha256, coalesce(changed, leaf) AS node, "
                f"{fields} FROM e JOIN s ON s.tree = e.tree JOIN r ON true {joins})")
    ctes += [f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {t}l IS NULL THEN node ELSE sha256({t}l || node || {t}r) END AS node) FROM f{j})"
             for j, t in enumerate(steps)]
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM f{len(steps)}")


SQL["op11_manifest"] = _merkle_sql()


SQL["op12_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0b\f\r]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
    FROM w, range(1, 6) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE a >= 100 AND m >= 2),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c AS x WHERE NOT EXISTS (SELECT 1 FROM c AS y WHERE y.lang = x.lang AND y.m > x.m
    AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a)),
z AS (SELECT k.lang, k.phrase, k.k, k.a, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score
    FROM k JOIN f AS l ON l.lang = k.lang AND l.phrase = array_to_string(s[1:k], ' ')
    JOIN f AS r ON r.lang = k.lang AND r.phrase = array_to_string(s[k + 1:], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000
"""
