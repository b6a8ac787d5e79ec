"""The manifest against a plain version, with odd rows, and descents for single requests."""

import helpers as H
import pytest
from gleaner.llm import merkle, queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain_order(rows):
    return sorted(rows, key=str)


def documents(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(3) for n in ("tree", "rank", "digest", "n", "path", "run", "place")}).write.parquet(
        f"{folder}/documents.parquet")


CASES = {
    "odd": [(None, "Null id", "en", None, 7), (None, None, None, None, None), (5, "", "en", "", 0), (5, "AbC", "en", "b", 3), (5, "AbC", "en", "b", 3),
            (-7, "É ab", "fr", "é", 4), (15, "no capitals", "en", "b", 11), (2, "x:1-" * 40_000, "en", "a b", 160_000)],
    "one": [(1, "Single", "en", "s", 6)],
    "one source": [(i, f"Text {i}", "en", "s", 5) for i in range(17)],
    "hot": [(i, f"Text {i}", "en", "hot" if i % 3 else f"src{i % 60}", i) for i in range(600)] + [(9999, "Same", "en", "hot", 4)] * 40,
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_brute_force(spark, tmp_path, case):
    documents(spark, tmp_path, CASES[case])
    got = queries.QUERIES["op11_manifest"](spark, str(tmp_path)).select(*COLUMNS).collect()
    assert plain_order(map(tuple, got)) == plain_order(H.merkle(CASES[case]))


def test_manifest_of_nothing(spark, tmp_path):
    documents(spark, tmp_path, [])
    got = queries.QUERIES["op11_manifest"](spark, str(tmp_path))
    assert got.columns == COLUMNS and got.count() == 0


def test_single_requests_descend_alone(spark):
    rows = [("s" + "ab"[i % 2], i, F"{i:064x}") for i in range(700)]
    made = merkle.manifest(spark.createDataFrame(rows, "tree string, doc_id long, digest string").persist(), ["doc_id"])
    asked = spark.createDataFrame([("sa", 0), ("sb", 349), ("sb", 16), ("sb", 350), ("none", 0)], "tree string, rank long")
    got = merkle.proofs(made, asked).withColumn("root", merkle.folded(F.col("digest"), F.col("path"))).collect()
    assert sorted((r["tree"], r["rank"], r["doc_id"], r["root"]) for r in got) == [
        ("sa", 0, 0, made.root), ("sb", 16, 33, made.root), ("sb", 349, 699, made.root)]
    assert {len(r["path"]) for r in got} == {4}
    all_paths = {(r["tree"], r["rank"]): r["path"] for r in merkle.proofs(made).collect()}
    assert len(all_paths) == 700 and all(all_paths[r["tree"], r["rank"]] == r["path"] for r in got)
    assert made.leaves().count() == 700
