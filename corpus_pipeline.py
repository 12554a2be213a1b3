"""The corpus pipeline: five stages over the documents, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordwarden.llm import mixing, packing, quality, secrets, simhash
from recordwarden.llm.common import staged
from recordwarden.llm.queries import MIXTURE, documents, ratings, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the highest grade; toxic and low-quality ones go."""
    model = quality.train(docs, ratings(spark, sf_dir))
    return quality.score(docs, model).where("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every SimHash group. Rows without an id stay."""
    groups = simhash.simhash_groups(docs, shingle=3, max_distance=2)
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the secrets found in a text are replaced, and n_chars follows."""
    model = secrets.train(secrets.labelled_strings(docs))
    masked = secrets.masked(secrets.scan(docs, model, kept=docs.columns))
    return masked.select([
        F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ])


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice."""
    return mixing.mixed_documents(docs, MIXTURE)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary(), capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", packed_sequences),
]

#: Hashes, trained models and a tokenizer decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline_{k}")
    return docs
