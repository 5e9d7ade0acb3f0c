"""A corpus from documents to packed sequences, in stages that each leave a table.

Every stage works on all rows that the one before kept. The columns of ``documents``
stay up to the last stage, which returns the placed pieces of every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import unused, written
from quernstone.llm.mixing import mixed_documents
from quernstone.llm.near_duplicates import deduplicated
from quernstone.llm.packing import pack_documents
from quernstone.llm.quality import good_documents
from quernstone.llm.secrets import redact_documents
from quernstone.sources import load


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    return good_documents(docs, load(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8 or more)."""
    return deduplicated(docs, size=5)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; ``n_chars`` follows where the text changed."""
    before = unused(docs, "text_before")
    new = redact_documents(docs.withColumn(before, F.col("text")))
    same = F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return new.withColumn("n_chars", n_chars).drop(before)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, placed in a sequence of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good),
    ("near duplicates", distinct),
    ("secret scan", masked),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: A trained classifier, a trained network and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
