"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a table, which is written and reread as the
next stage's documents. All but the last return the columns of ``documents``.

In every stage null ids, repeated rows and further columns of any name are kept as rows are kept; null texts have no letters,
so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import contamination, language, mixing, neardup, privacy
from gleaner.llm.common import free_names, small_batches
from gleaner.session import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; rejected are texts without letters and texts that fit no profile at all."""
    small_batches(spark)
    known = language.profiles(docs, F.lit(True))
    lang, score = free_names(docs, "__lang", "__score")
    judged = language.predicted(docs, known, names=(lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) >= 0.1)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8); of rows alike one stays."""
    small_batches(spark)
    return neardup.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of similarity 0.8 to a benchmark item."""
    small_batches(spark)
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and disclosing terms generalised or removed; ``n_chars`` is that of the new text."""
    small_batches(spark)
    return privacy.sanitised(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; rows alike are drawn one by one."""
    small_batches(spark)
    return mixing.repeated(docs)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("PII", personal_data), ("mixing sources to target weights", mixture)]

ORACLE_SQL = None  # profiles, sketches and random rounding are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
