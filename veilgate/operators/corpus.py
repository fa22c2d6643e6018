"""Preparing a chunk corpus: chunking, visibility, terms, embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.functions import sqltext, vectors
from veilgate.functions.rules import RuleSet
from veilgate.functions.text import MAX_CHUNK_WORDS, embedding_key, terms, word_pieces
from veilgate.operators.keyed import balanced_join
from veilgate.operators.shield import classify, shield
from veilgate.session import settle

VISIBLE_CLASSES = ("STANDARD", "INTERNAL")
MIN_RETRIEVAL_SCORE = 0.40


def chunk_documents(
    documents: DataFrame, document: str, text: str, size: int = MAX_CHUNK_WORDS
) -> DataFrame:
    """One row per chunk: ``chunk_id``, ``chunk_index`` and ``chunk_text`` beside the other columns."""
    kept = [c for c in documents.columns if c != text]
    pieces = word_pieces(sqltext.name(text), size)
    return documents.select(*kept, F.posexplode(pieces).alias("chunk_index", "chunk_text")).withColumn(
        "chunk_id", F.concat_ws(":", F.col(document).cast("string"), F.col("chunk_index"))
    )


def chunk_counts(chunks: DataFrame, document: str) -> DataFrame:
    return chunks.groupBy(document).agg(F.count(F.lit(1)).alias("total_chunks"))


def visible(chunks: DataFrame) -> DataFrame:
    """Row-level security: only classes open to agents, and only active chunks."""
    return chunks.where(F.col("data_class").isin(*VISIBLE_CLASSES) & F.col("is_active"))


def prefilter(
    chunks: DataFrame, as_of: str, domain: str = "all", freshness_days: int | None = None
) -> DataFrame:
    """Metadata filter applied before any scoring, so it reaches the scan."""
    kept = visible(chunks)
    if domain != "all":
        kept = kept.where(F.col("domain") == domain)
    if freshness_days is not None:
        cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(freshness_days))
        kept = kept.where(F.col("updated_at") >= cutoff)
    return kept


def minimum_score(df: DataFrame, score: str, least: float = MIN_RETRIEVAL_SCORE) -> DataFrame:
    return df.where(F.col(score) >= least)


def with_terms(chunks: DataFrame, text: str) -> DataFrame:
    """Store the search terms of a chunk next to it (the text-vector column)."""
    return chunks.withColumn("terms", terms(f"coalesce({sqltext.name(text)}, '')")).withColumn(
        "doc_len", F.size("terms")
    )


def with_safe_text(chunks: DataFrame, text: str, rules: RuleSet) -> DataFrame:
    """Add ``chunk_text_safe`` and the sorted ``pii_classification`` of each chunk."""
    return (
        shield(chunks, text, rules)
        .withColumn("pii_classification", classify(F.col("detections")))
        .withColumnRenamed("safe_text", "chunk_text_safe")
        .select(*chunks.columns, "chunk_text_safe", "pii_classification")
    )


def outdated_embeddings(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks whose vector is missing or comes from another model."""
    return chunks.where(~F.col("embedding_model_id").eqNullSafe(model))


def with_dimension_check(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    return df.withColumn("dimension_ok", vectors.has_dimension(F.col(vector), dimension))


def normalised(df: DataFrame, vector: str, out: str) -> DataFrame:
    return (
        df.withColumn("_length", vectors.norm(F.col(vector)))
        .withColumn(out, vectors.scaled(F.col(vector), F.col("_length")))
        .drop("_length")
    )


def pseudo_embed(df: DataFrame, text: str, dimension: int, out: str = "embedding") -> DataFrame:
    """Reproducible unit vectors from the text alone."""
    raw = df.withColumn("_raw", vectors.pseudo_components(F.md5(text), dimension))
    return normalised(raw, "_raw", out).drop("_raw")


def batch_embedder(embed: Callable[[list[str]], Sequence], dimension: int):
    """Wrap a batch embedding function as a vectorised UDF; wrong sizes fail the task."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = [np.asarray(v, dtype="float32") for v in embed(texts.fillna("").tolist())]
        for row in rows:
            if row.shape != (dimension,):
                raise ValueError(f"embedding dimension mismatch: {row.shape} != ({dimension},)")
        return pd.Series(rows)

    return run


def embed_once(
    df: DataFrame, text: str, embed: Callable[[Column], Column], out: str = "embedding"
) -> DataFrame:
    """Embed each distinct normalised text once and attach the vectors to all its copies."""
    keyed = df.withColumn("_key", embedding_key(F.col(text)))
    distinct = keyed.groupBy("_key").agg(F.min(text).alias("_text"))
    # written before it is measured and joined, or every text would be embedded again for each
    embedded = settle(distinct.select("_key", embed(F.col("_text")).alias(out)), "embedded")
    return balanced_join(keyed, embedded, ["_key"], "left").drop("_key")


def cache_hit_rate(df: DataFrame, text: str) -> DataFrame:
    """Share of texts that an embedding cache without eviction would have answered."""
    per_key = df.groupBy(embedding_key(F.col(text)).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("calls"),
        F.count(F.lit(1)).alias("distinct_texts"),
    ).withColumn(
        "hit_rate",
        F.when(F.col("calls") > 0, 1 - F.col("distinct_texts") / F.col("calls")).otherwise(0.0),
    )
