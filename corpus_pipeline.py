"""The corpus pipeline: quality, near-dedup, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next stage's input.
All stages but the last keep the columns of ``documents``.

Edge cases (the operators' modules have more): null and empty texts are scored
like others and, where they stay, pack as a lone end id; rows without doc_id
cannot be told apart as copies and are not removed as such, but are judged,
cut and redacted like all others; repeated rows are copies of one document, of
which one stays; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from polyphon.llm import decontaminate, near_dups, packing, quality, secrets
from polyphon.llm.base import table
from polyphon.llm.queries import WORD_TOKENIZER
from polyphon.sources.workspace import materialize

QUALITY_LIMIT = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it learns from the labels of this input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, "__llm_quality").where(F.col("__llm_quality") >= QUALITY_LIMIT).drop("__llm_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    classes = near_dups.near_duplicates(docs)
    gone = classes.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Rows that share an id are copies of one document: the one with the smallest row hash stays.
    named = left.where("doc_id IS NOT NULL")
    first = named.groupBy("doc_id").agg(F.count("*").alias("__llm_n"), F.min(F.xxhash64(*docs.columns)).alias("__llm_row")).where("__llm_n > 1")
    single = named.join(first, "doc_id", "left_anti").select(*docs.columns)
    chosen = named.join(first, "doc_id").where(F.xxhash64(*(F.col(c) for c in docs.columns)) == F.col("__llm_row")).select(*docs.columns)
    return single.unionByName(chosen.dropDuplicates(["doc_id"])).unionByName(left.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the words that benchmark windows hit are cut out.

    A row's columns go through the scan with its text, so its own verdict and its
    own spans apply, whatever its id is: null ids and ids with several texts too.
    """
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), with_row=True, cut=True)
    left = decontaminate.with_verdict(found).where("NOT contaminated")
    return _counted(left.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns)))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced; all documents stay."""
    return _counted(secrets.redact(docs))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_TOKENIZER)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_redaction),
    ("packing", curve_packing),
]

#: SQL expresses neither the model nor the tokenizer; tests/llm compares with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
