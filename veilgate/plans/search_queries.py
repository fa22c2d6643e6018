"""Queries about the corpus, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.ids import stable_id
from veilgate.functions.rules import RECOMMENDED_RULES
from veilgate.functions.text import embedding_key
from veilgate.functions.vectors import pseudo_components
from veilgate.operators import corpus, dense, guards, postings, search
from veilgate.plans import tables as T
from veilgate.session import settle

PSEUDO_SIZE = 16


def chunking(spark: SparkSession, sf: str) -> DataFrame:
    pieces = corpus.chunk_documents(T.documents(spark, sf), "document_id", "text")
    return pieces.select("chunk_id", "document_id", "chunk_index", "chunk_text")


def chunk_counts(spark, sf):
    pieces = corpus.chunk_documents(T.documents(spark, sf), "document_id", "text")
    return corpus.chunk_counts(pieces, "document_id")


def safe_chunks(spark, sf):
    pieces = corpus.chunk_documents(T.documents(spark, sf), "document_id", "text")
    safe = corpus.with_safe_text(pieces, "chunk_text", RECOMMENDED_RULES)
    return safe.select(
        "chunk_id",
        "chunk_text_safe",
        F.array_join("pii_classification", ",").alias("pii_classification"),
    )


def prefilter_rls(spark, sf):
    kept = corpus.prefilter(T.documents(spark, sf), T.AS_OF, "en", 90)
    return kept.select("document_id", "domain", "data_class", "updated_at")


def text_terms(spark, sf):
    """Frequency of every search term in every document."""
    stored = corpus.with_terms(T.documents(spark, sf), "text")
    return (
        stored.select("document_id", "doc_len", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.countDistinct("document_id").alias("df"))
    )


def l2_normalize(spark, sf):
    unit = corpus.normalised(T.table(spark, sf, "embeddings"), "embedding", "unit")
    return unit.select(
        "vec_id",
        F.round(F.element_at("unit", 1), 6).alias("first"),
        F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


def dim_check(spark, sf):
    vectors = T.table(spark, sf, "embeddings").withColumn(
        "embedding",
        F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")),
    )
    checked = corpus.with_dimension_check(vectors, "embedding", 64)
    return checked.select("vec_id", "dimension_ok")


def reembed_needed(spark, sf):
    return corpus.outdated_embeddings(T.documents(spark, sf), "current-model").select("document_id")


def demo_embed(spark, sf):
    made = corpus.pseudo_embed(T.texts(spark, sf), "text", PSEUDO_SIZE)
    return made.select(
        "text_id",
        F.round(F.element_at("embedding", 1), 6).alias("first"),
        F.round(F.element_at("embedding", PSEUDO_SIZE), 6).alias("last"),
    )


def embed_dedup(spark, sf):
    made = corpus.embed_once(
        T.texts(spark, sf), "text", lambda t: pseudo_components(embedding_key(t), PSEUDO_SIZE)
    )
    return made.select(
        "text_id",
        embedding_key(F.col("text")).alias("text_key"),
        F.element_at("embedding", 1).alias("first"),
    )


def cache_hit_rate(spark, sf):
    rate = corpus.cache_hit_rate(T.texts(spark, sf), "text")
    return rate.withColumn("hit_rate", F.round("hit_rate", 6))


def _corpus_vectors(spark, sf):
    vectors = T.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("document_id"), "embedding"
    )
    return (
        corpus.visible(T.documents(spark, sf))
        .join(vectors, "document_id")
        .withColumnRenamed("document_id", "chunk_id")
    )


def dense_topk(spark, sf):
    return dense.dense_top(_corpus_vectors(spark, sf), T.queries(spark, sf), 10)


def min_score(spark, sf):
    top = dense.dense_top(_corpus_vectors(spark, sf), T.queries(spark, sf), 10)
    return corpus.minimum_score(top, "dense").select("query_id", "chunk_id", "dense")


def ann_topk(spark, sf):
    """Clustered search that probes every cluster, so it has to equal the exact one."""
    return dense.dense_top_clustered(
        _corpus_vectors(spark, sf), T.queries(spark, sf), 10, centroids=16, probes=16
    )


def bm25_topk(spark, sf):
    """The best chunks by BM25, from the posting blocks of the query terms."""
    return postings.search(spark, T.term_index(spark, sf), T.queries(spark, sf), "query", 10)


def bm25_scan(spark, sf):
    """The same by a scan of all chunks, as searches without a stored index do it."""
    return search.keyword_search(T.search_corpus(spark, sf), T.queries(spark, sf), "query", 10)


def rrf_search(spark, sf):
    found = search.hybrid_search(T.search_corpus(spark, sf), T.queries(spark, sf), "query")
    return found.select(
        "query_id",
        "chunk_id",
        F.coalesce("dense", F.lit(-9.0)).alias("dense"),
        "sparse",
        "dense_rank",
        "sparse_rank",
        F.round("combined", 10).alias("combined"),
        "position",
    )


def sparse_hits_search(spark, sf):
    """Searches for a single word without a vector: fewer chunks than asked for have any score."""
    asked = T.queries(spark, sf).withColumns(
        {
            "query": F.regexp_extract("query", r"(\S+)\s*$", 1),
            "query_vector": F.lit(None).cast("array<float>"),
        }
    )
    found = search.hybrid_search(T.search_corpus(spark, sf), asked, "query")
    return found.select("query_id", "chunk_id", "sparse", "dense_rank", "sparse_rank", "position")


def empty_search_calls(spark, sf):
    """Every second search may see nothing at all and is answered and logged all the same."""
    asked = T.queries(spark, sf).withColumn(
        "cutoff",
        F.when(F.col("query_id").cast("int") % 2 == 0, F.lit("2099-01-01").cast("timestamp")).otherwise(
            F.col("cutoff")
        ),
    )
    found = settle(
        search.governed_search(
            T.search_corpus(spark, sf), asked, RECOMMENDED_RULES, on_block="drop"
        ),
        "search-calls",
    )
    logged = search.search_audit(found, F.lit(T.AS_OF).cast("timestamp")).select(
        "event_id", F.size("chunk_ids").alias("logged_chunks")
    )
    rows = found.withColumn("event_id", stable_id(F.lit("MCP_TOOL_CALL"), F.col("query_id")))
    return rows.join(logged, "event_id").select(
        "query_id", "total_found", "returned", "position", "chunk_id", "logged_chunks"
    )


def governed_search(spark, sf):
    return search.governed_search(
        T.search_corpus(spark, sf), T.queries(spark, sf), RECOMMENDED_RULES
    )


def governed_search_drop(spark, sf):
    """The same search, leaving out blocked chunks instead of refusing the whole query."""
    return search.governed_search(
        T.search_corpus(spark, sf), T.queries(spark, sf), RECOMMENDED_RULES, on_block="drop"
    ).select("query_id", "total_found", "returned", "position", "chunk_id", "text", "pii_masked")


def search_metadata(spark, sf):
    """Returned chunks with the metadata stored beside them."""
    chunks = T.search_corpus(spark, sf).withColumn("metadata", F.struct("domain", "source_uri", "updated_at"))
    found = search.governed_search(chunks, T.queries(spark, sf), RECOMMENDED_RULES)
    return found.select("query_id", "position", "chunk_id", "metadata.domain", "metadata.source_uri", "metadata.updated_at")


def search_refusals(spark, sf):
    """An event for every search that was refused."""
    events = search.search_refusals(governed_search(spark, sf), F.lit(T.AS_OF).cast("timestamp"))
    return events.select("event_id", "event_type", "agent_id", "session_id", "query_hash", "severity", "timestamp")


def search_audit(spark, sf):
    found = governed_search(spark, sf)
    events = search.search_audit(found, F.lit(T.AS_OF).cast("timestamp"))
    return events.select(
        "event_id",
        "tool_name",
        "agent_id",
        "agent_role",
        "session_id",
        "query_hash",
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
        "pii_detected",
        "severity",
    )


def context_assembly(spark, sf):
    """Search results put together as prompts, then inspected by the prompt guard."""
    asked = search.assemble_prompts(governed_search(spark, sf))
    done = guards.guard_prompts(asked, "prompt", RECOMMENDED_RULES, "agent_role")
    return done.select("query_id", "action", "pii_detected", "safe_prompt")


def answer_flow(spark, sf):
    """All layers in a row: search, context, prompt guard, an echoing model, response guard, log."""
    found = search.governed_search(
        T.search_corpus(spark, sf), T.queries(spark, sf), RECOMMENDED_RULES, on_block="drop"
    )
    asked = search.assemble_prompts(found)
    prompts = guards.guard_prompts(asked, "prompt", RECOMMENDED_RULES, "agent_role")
    answered = prompts.where(F.col("action") != "blocked").withColumnRenamed(
        "safe_prompt", "response"
    )
    answered = answered.select("query_id", "agent_id", "session_id", "response")
    responses = guards.guard_responses(answered, "response", blocking=False)
    return responses.select("query_id", "leakage", "risk", "action", "safe_response")


def _fetched(spark, sf):
    requests = T.table(spark, sf, "customer").selectExpr(
        "c_custkey AS request_id",
        "CAST(c_custkey AS STRING) AS document_id",
        f"{T.pick(T.ROLES, 'c_nationkey')} AS agent_role",
    )
    stored = T.documents(spark, sf).selectExpr(
        "document_id", "text", "data_class", "is_active", "source_uri AS title"
    )
    return search.fetch_documents(requests, stored, "text", RECOMMENDED_RULES)


def document_fetch(spark, sf):
    """Every customer asks for a document; missing, restricted and inactive ones are refused alike."""
    return _fetched(spark, sf).select(
        "request_id", "document_id", "error", "status", "content", "pii_masked", "title"
    )


def document_audit(spark, sf):
    events = search.fetch_audit(_fetched(spark, sf), "request_id", F.lit(T.AS_OF).cast("timestamp"))
    return events.select(
        "event_id",
        "tool_name",
        "agent_role",
        F.array_join("chunk_ids", ",").alias("chunk_ids"),
        "pii_detected",
        "severity",
    )


def quality_gate(spark, sf):
    """User turns as questions, the next turn as answer, the turns around them as context."""
    turns = T.table(spark, sf, "conversations")

    def neighbour(step: int, name: str) -> DataFrame:
        return turns.select(
            "conv_id", (F.col("turn") - step).alias("turn"), F.col("text").alias(name)
        )

    asked = (
        turns.where(F.col("role") == "user")
        .join(neighbour(1, "answer"), ["conv_id", "turn"])
        .join(neighbour(-1, "before"), ["conv_id", "turn"], "left")
        .join(neighbour(2, "after"), ["conv_id", "turn"], "left")
        .withColumn("contexts", F.array_compact(F.array("before", "after")))
    )
    return search.retrieval_quality(asked, "text", "answer", "contexts").select(
        "conv_id",
        "turn",
        "num_chunks",
        "faithfulness",
        "answer_relevancy",
        "context_precision",
        "context_recall",
        "quality_gate",
        "recommendation",
    )


QUERIES = {
    f.__name__: f
    for f in (
        chunking,
        chunk_counts,
        safe_chunks,
        prefilter_rls,
        text_terms,
        l2_normalize,
        dim_check,
        reembed_needed,
        demo_embed,
        embed_dedup,
        cache_hit_rate,
        dense_topk,
        min_score,
        ann_topk,
        bm25_topk,
        bm25_scan,
        rrf_search,
        sparse_hits_search,
        empty_search_calls,
        governed_search,
        governed_search_drop,
        search_audit,
        search_metadata,
        search_refusals,
        context_assembly,
        answer_flow,
        document_fetch,
        document_audit,
        quality_gate,
    )
}
