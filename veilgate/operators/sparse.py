"""Full-text scoring (BM25) from term rows, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.functions.text import terms
from veilgate.operators.keyed import is_small, salted_join
from veilgate.session import settle

K1 = 1.2
B = 0.75
DIGITS = 6


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """Distinct search terms per query with the query's own filters."""
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        "domain",
        "cutoff",
        F.explode(F.array_distinct(terms(f"coalesce({sqltext.name(text)}, '')"))).alias("term"),
    )


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and average length, over chunks with a ``doc_len``."""
    return chunks.agg(
        F.count(F.lit(1)).cast("double").alias("chunks"), F.avg("doc_len").alias("average_length")
    )


def term_rows(chunks: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(chunk, term, frequency) rows restricted to the terms asked for."""
    columns = ["chunk_id", "domain", "updated_at", "doc_len", "term"]
    exploded = chunks.select(*columns[:-1], F.explode("terms").alias("term"))
    if small:
        wanted = exploded.join(F.broadcast(vocabulary), "term", "left_semi")
        return wanted.groupBy(*columns).agg(F.count(F.lit(1)).alias("tf"))
    counted = exploded.groupBy(*columns).agg(F.count(F.lit(1)).alias("tf"))
    return salted_join(counted, vocabulary, ["term"], "left_semi", spread=["chunk_id"])


def document_frequencies(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(chunks: DataFrame, queries: DataFrame, text: str) -> DataFrame:
    """Every (query, chunk) pair sharing a term, with its score (6 digits, positive only).

    ``chunks`` needs ``terms`` and ``doc_len`` (see ``with_terms``); statistics are taken over all
    chunks given, a query's domain and cutoff only restrict what it may return.
    """
    asked = settle(query_terms(queries, text), "query-terms")
    small = is_small(asked)
    rows = settle(term_rows(chunks, asked.select("term").distinct(), small), "term-rows")
    statistics = corpus_statistics(chunks)
    total = statistics.select("chunks").scalar()
    average = statistics.select("average_length").scalar()
    weighted = asked.join(document_frequencies(rows), "term").select(
        "term",
        "query_id",
        F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        F.col("domain").alias("_domain"),
        F.col("cutoff").alias("_cutoff"),
    )
    if small:
        joined = rows.join(F.broadcast(weighted), "term")
    else:
        joined = salted_join(rows, weighted, ["term"], spread=["chunk_id"])
    pairs = joined.where(
        ((F.col("_domain") == "all") | (F.col("_domain") == F.col("domain")))
        & (F.col("_cutoff").isNull() | (F.col("updated_at") >= F.col("_cutoff")))
    )
    length = 1 - B + B * F.col("doc_len") / average
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length)
    return (
        pairs.groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(part), DIGITS).alias("sparse"))
        .where(F.col("sparse") > 0)
    )


def sparse_top(matched: DataFrame, k: int) -> DataFrame:
    """Top-k matched chunks per query with ``sparse_rank`` (ties share a rank)."""
    best_first = Window.partitionBy("query_id").orderBy(F.desc("sparse"), "chunk_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("sparse"))
    return (
        matched.withColumn("position", F.row_number().over(best_first))
        .where(F.col("position") <= k)
        .withColumn("sparse_rank", F.rank().over(by_score).cast("long"))
    )
