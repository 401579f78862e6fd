"""A training corpus from raw documents: quality rules, near duplicates, personal data, mixing of sources, packing.

Each stage takes what the one before it kept, as written to Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.jaccard_join import one_of_each
from planmatch.llm.mixing import mixed_documents
from planmatch.llm.packing import pack
from planmatch.llm.personal_data import find_personal_data
from planmatch.llm.quality_rules import clean_lines
from planmatch.llm.storage import shared_folder


def with_text(found: DataFrame, names: list[str], text: str) -> DataFrame:
    """The row kept aside in ``__row``, its text replaced and its n_chars counted anew."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail."""
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return with_text(clean_lines(aside, only_kept=True), docs.columns, "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"), "text")
    return with_text(find_personal_data(aside), docs.columns, "redacted_text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: Tokenisation and the labelling of personal data have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written below the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
