"""From raw documents to packed sequences: quality, near duplicates, personal data, mixture, packing.

Each stage works on every row that its predecessor kept and decides row by row: rows that repeat, or share a doc_id, or have none, or
whose text is null or empty are rows like any other, and columns beside doc_id, text and source pass through under whatever
name. A stage over no rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import mixing, packing, pii, quality, simhash
from tidelog.llm.common import table, written
from tidelog.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. Null and empty texts are scored as empty ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, that with the smallest doc_id (null last); texts without words are one component."""
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; null texts stay null."""
    return pii.mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that sources (null is one) come near their targets; rows without words go with none left."""
    return mixing.mix_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its sequence and its place there; a null or empty text is one piece with the end id."""
    return packing.op6_vector_best_fit(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("personal_data", personal_data_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL has neither zstandard nor the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
