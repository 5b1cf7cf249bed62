"""The corpus pipeline: from raw documents to packed token ids, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return docs' own columns, whatever their names.

Every stage works on all rows of docs and on whole texts, however long; a table without rows gives none; nulls may stand
in any column; equal rows are judged alike. What a stage does with nulls, ties and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.jaccard_join import keep_one
from tessera.llm.mixing import mix_rows
from tessera.llm.quality_rules import keep_quality, trusted_ids
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.shared import shared_folder
from tessera.llm.token_files import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep. A null text has no words and goes; a null doc_id is not
    trusted but judged as any other; a ratio equal to the threshold is kept."""
    return keep_quality(docs, trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one whose doc_id names it. Null and empty texts are classes of
    their own; rows without a doc_id stay; rows that repeat a doc_id are judged by their own texts, equal ones stay once."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. Null texts have no words and stay; benchmark items without id or
    words have no windows."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, each at least once. A null source is a source of its own;
    rows that repeat a doc_id are shown each, in order of their texts' digests where the budget's edge parts them."""
    return mix_rows(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, and what is read back from them per document. Null texts are the end id alone; null doc_ids
    come first; rows of one doc_id stand in order of their texts' hashes."""
    return token_digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_files),
]

#: SQL cannot express the hashed likelihood ratio, the chosen-path join and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        folder = shared_folder(spark, f"pipeline-{k}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
