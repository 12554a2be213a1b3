"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fm_index, lexical, mixing, near_vectors, neighbours, packing, passages, planes, quality, secrets, shards, simhash, whitening,
)

#: The flattest mixture that uses every source whole and none more than twice.
MIXTURE = mixing.Target(repetitions=2.0)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade) from the labels table."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality.grade_column().alias("grade"))


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir), shingle=3, max_distance=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, sf_dir), "vec_id % 20 = 0", k=20)


@register
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary(), capacity=1024)


@register
def op4_stable_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.vector_groups(embeddings(spark, sf_dir), cosine=0.9)


@register
def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.digest(secrets.scan(docs, secrets.train(secrets.labelled_strings(docs))))


@register
def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_stream(documents(spark, sf_dir), MIXTURE)


@register
def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(documents(spark, sf_dir), shards=40)


@register
def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, ratings(spark, sf_dir))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail", "keep")


@register
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir), window=50)


@register
def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_file_index(documents(spark, sf_dir), vocabulary())


@register
def op11_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(documents(spark, sf_dir), benchmark(spark, sf_dir), k=50)


@register
def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), components=8)


@register
def op13_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.contaminated_spans(documents(spark, sf_dir), benchmark(spark, sf_dir), window=10))
