"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; the last adds its own. Where a stage changes a
text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import remainder, written
from cohortlens.llm.decontaminate import remove_passages
from cohortlens.llm.line_spread import remove_spread_lines
from cohortlens.llm.mixing import mix
from cohortlens.llm.near_dedup import drop_near_duplicates
from cohortlens.llm.toxicity import score_toxicity
from cohortlens.session import make_importable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    make_importable(spark)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(F.col("doc_id"), 5) != 0)
    return scored.where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites stay in their first document only; documents that had nothing else go."""
    cleaned = remove_spread_lines(docs)
    return _with_length(cleaned.where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_lines") == 0)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id."""
    make_importable(spark)
    return drop_near_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; so do documents that are mostly benchmark text."""
    make_importable(spark)
    return _with_length(remove_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the expected token shares of the quality domains to their targets; rate 0 goes."""
    make_importable(spark)
    return mix(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).where("rate > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]
#: Toxicity and mixing are learned, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
