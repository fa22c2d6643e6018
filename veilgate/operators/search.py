"""Hybrid retrieval: exact reciprocal rank fusion, and the governed search built on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.functions.ids import sha256_hex, stable_id
from veilgate.functions.rules import RuleSet
from veilgate.functions.text import words, words_of
from veilgate.operators import scan
from veilgate.operators.corpus import visible as visible_rows
from veilgate.operators.guards import sanitise_queries
from veilgate.operators.keyed import BROADCAST_ROWS, balanced_join
from veilgate.operators.shield import shield
from veilgate.operators.sparse import sparse_top
from veilgate.session import settle

# Fixed value: the answer to a request for a document that is missing or closed.
DOCUMENT_REFUSED = "Document not found or access denied"

RRF_CONSTANT = 60
HYBRID = (
    "query_id string, chunk_id string, dense double, sparse double, dense_rank long, sparse_rank long, "
    "combined double, position int"
)
DEFAULT_TOP_K = 10
MAX_TOP_K = 20
RERANK_TOP_K = 3


def _attach(small: DataFrame, large: DataFrame, keys: list[str], rows: int | None) -> DataFrame:
    """Join a candidate list with a big table unique on the keys; ``rows`` is the list's size."""
    if rows is not None and rows <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), keys)
    return small.join(large, keys)


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, text: str, k: int = DEFAULT_TOP_K
) -> DataFrame:
    """Top-k chunks per query by reciprocal rank fusion over the *whole* filtered corpus.

    ``chunks``: chunk_id, embedding, domain, updated_at, terms, doc_len. ``queries``: query_id,
    query text, query_vector, domain, cutoff. Ranks are those of RANK() over all chunks a query
    may see; a chunk without any query term, or without a vector, shares the rank after the last
    scored one.

    Why a short list is enough: k chunks have a dense rank of at most k, so each of them fuses to
    at least 1/(60+k). The lists hold the ``depth`` best by one score, ties going by the other and then
    by id. A chunk outside both is either tied with the end of a list and dominated by k chunks of it, or
    ranks below ``depth - k`` in both, hence at most 2/(61+depth-k), which is no more than 1/(60+k) once
    depth >= 59+3k. Chunks without any score are in the lists as the last of all, so a query gets
    min(k, visible chunks) rows. A second scan counts the scores above those of the short list, which
    gives exact ranks without sorting the corpus or writing pairs.
    """
    depth = RRF_CONSTANT - 1 + 3 * k
    found = [_fused(part, asked, depth, k) for asked, part in scan.batches(chunks, queries, text)]
    if not found:
        return chunks.sparkSession.createDataFrame([], HYBRID)
    return reduce(DataFrame.unionByName, found)


def _fused(chunks: DataFrame, asked: scan.Asked, depth: int, k: int) -> DataFrame:
    """The k best of one batch of queries."""
    lists = settle(scan.best_lists(chunks, asked, depth), "lists")

    def head(side: str, order: list[Column]) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(*order, "chunk_id")
        mine = lists.where(F.col("side") == side).withColumn("_place", F.row_number().over(best))
        return mine.where(F.col("_place") <= depth).select("query_id", "chunk_id", "dense", "sparse")

    both = settle(
        head("sparse", [F.desc("sparse"), F.desc("dense")])
        .unionByName(head("dense", [F.desc("dense"), F.desc("sparse")]))
        .distinct(),
        "candidates",
    )
    # at most 2 depth marks per query and side, for at most BATCH_QUERIES queries
    marks = both.groupBy("query_id").agg(
        F.sort_array(F.collect_set("dense")).alias("dense"), F.sort_array(F.collect_set("sparse")).alias("sparse")
    )
    known = {r.query_id: (np.array(r.dense), np.array(r.sparse)) for r in marks.collect()}
    none = (np.empty(0), np.empty(0))
    marked = replace(asked, marks=[known.get(q, none) for q in asked.ids])
    above = settle(
        scan.counts_above(chunks, marked).groupBy("query_id", "side", "mark").agg(F.sum("n").alias("n")), "above"
    )

    def rank(side: str) -> DataFrame:
        return above.where(F.col("side") == side).select(
            "query_id", F.col("mark").alias(side), (F.col("n") + 1).alias(f"{side}_rank")
        )

    fused = (
        both.join(rank("dense"), ["query_id", "dense"])
        .join(rank("sparse"), ["query_id", "sparse"])
        .withColumn(
            "combined",
            F.lit(1.0) / (RRF_CONSTANT + F.col("dense_rank")) + F.lit(1.0) / (RRF_CONSTANT + F.col("sparse_rank")),
        )
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("combined"), "chunk_id")
    return (
        fused.withColumn("position", F.row_number().over(best_first))
        .where(F.col("position") <= k)
        .select(
            "query_id",
            "chunk_id",
            F.when(F.col("dense") > scan.NO_VECTOR, F.col("dense")).alias("dense"),
            "sparse",
            "dense_rank",
            "sparse_rank",
            "combined",
            "position",
        )
    )


def keyword_search(chunks: DataFrame, queries: DataFrame, text: str, k: int) -> DataFrame:
    """Top-k chunks per query by BM25, among those sharing a term, with ``sparse_rank`` (ties share a rank)."""
    found = [
        scan.best_lists(part, asked, k, matched_only=True).select("query_id", "chunk_id", "sparse")
        for asked, part in scan.batches(chunks, queries, text)
    ]
    if not found:
        found = [chunks.sparkSession.createDataFrame([], "query_id string, chunk_id string, sparse double")]
    return sparse_top(reduce(DataFrame.unionByName, found), k)


def effective_k(requested: Column, role_limit: Column | None = None) -> Column:
    """Requested size clamped by the global limit, the re-rank limit and the role's limit."""
    limits = [requested, F.lit(MAX_TOP_K), F.lit(RERANK_TOP_K)]
    if role_limit is not None:
        limits.append(role_limit)
    return F.least(*limits)


def governed_search(
    chunks: DataFrame,
    queries: DataFrame,
    rules: RuleSet,
    on_block: str = "abort",
    retrieve: int = DEFAULT_TOP_K,
    scorer: Callable[[DataFrame], Column] | None = None,
    retrieved: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sanitise, retrieve, shield, re-rank and shape: one row per returned chunk.

    A call without a chunk to return has one row too, with ``returned`` and ``position`` 0 and no text.

    ``queries``: query_id, query, query_vector, domain, cutoff, top_k, agent_id, agent_role,
    session_id. With ``on_block='abort'`` one blocked chunk makes the whole query ``blocked`` and
    returns a single row without text; ``drop`` leaves only that chunk out. ``scorer`` replaces
    the fused score as the re-ranking score and sees protected text only. ``embed`` makes the query
    vectors from the sanitised queries; without it ``query_vector`` is taken as given. A column ``metadata`` of
    the chunks, of any type, comes back with each returned chunk.
    """
    safe = sanitise_queries(
        queries.withColumn("query_id", F.col("query_id").cast("string")), "query", rules, "agent_role"
    )
    if embed is not None:
        safe = settle(safe.withColumn("query_vector", embed(F.col("safe_query"))), "safe-queries")
    found = retrieved if retrieved is not None else hybrid_search(chunks, safe, "safe_query", retrieve)
    about = safe.select(
        "query_id", "safe_query", "top_k", "agent_id", "agent_role", "session_id"
    )
    extra = ["metadata"] if "metadata" in chunks.columns else []
    texts = chunks.select("chunk_id", "document_id", "chunk_text", *extra)
    found = settle(found.drop("position"), "found")
    with_text = about.join(_attach(found, texts, ["chunk_id"], found.count()), "query_id", "left")
    checked = shield(with_text, "chunk_text", rules, "agent_role")
    checked = checked.withColumn("score", scorer(checked) if scorer else F.col("combined"))
    whole = Window.partitionBy("query_id")
    call = checked.withColumn("_blocked", F.col("status") == "blocked")
    call = (
        call.withColumn("total_found", F.count("chunk_id").over(whole))
        .withColumn("any_blocked", F.bool_or("_blocked").over(whole))
        .withColumn("pii_detected", F.bool_or("was_modified").over(whole))
    )
    shown = F.col("chunk_id").isNotNull()
    if on_block == "drop":
        shown = shown & ~F.col("_blocked")
    best_first = whole.orderBy(F.desc("_shown"), F.desc("score"), "chunk_id")
    # a call that has nothing to show keeps one row, so every call is answered and can be logged
    ranked = (
        call.withColumn("_shown", shown)
        .withColumn("position", F.row_number().over(best_first))
        .where(
            F.when(F.col("_shown"), F.col("position") <= effective_k(F.col("top_k"))).otherwise(
                F.col("position") == 1
            )
        )
        .withColumn("returned", F.count_if("_shown").over(whole))
    )
    aborted = F.col("any_blocked") if on_block == "abort" else F.lit(False)
    empty = aborted | ~F.col("_shown")
    visible = lambda c: F.when(~empty, F.col(c))
    return ranked.where(~aborted | (F.col("position") == 1)).select(
        "query_id",
        "agent_id",
        "agent_role",
        "session_id",
        F.col("safe_query").alias("query"),
        F.when(aborted, "blocked").otherwise("ok").alias("status"),
        F.when(aborted, F.lit(0)).otherwise(F.col("total_found")).cast("long").alias("total_found"),
        F.when(aborted, F.lit(0)).otherwise(F.col("returned")).cast("long").alias("returned"),
        F.when(empty, F.lit(0)).otherwise(F.col("position")).cast("int").alias("position"),
        visible("chunk_id").alias("chunk_id"),
        visible("document_id").alias("document_id"),
        visible("safe_text").alias("text"),
        F.round(visible("score"), 4).alias("score"),
        *[visible(c).alias(c) for c in extra],
        (F.col("was_modified") & ~empty).alias("pii_masked"),
        (F.col("pii_detected") | aborted).alias("pii_detected"),
    )


def search_refusals(results: DataFrame, at: Column) -> DataFrame:
    """One event per search that a blocked chunk has refused; the query is hashed, never stored."""
    return results.where(F.col("status") == "blocked").select(
        stable_id(F.lit("PII_BLOCKED"), F.col("query_id")).alias("event_id"),
        F.lit("PII_BLOCKED").alias("event_type"),
        F.lit("search_knowledge_base").alias("tool_name"),
        "agent_id",
        "agent_role",
        "session_id",
        sha256_hex(F.col("query")).alias("query_hash"),
        F.array().cast("array<string>").alias("chunk_ids"),
        F.lit(True).alias("pii_detected"),
        F.lit("WARNING").alias("severity"),
        at.alias("timestamp"),
    )


def search_audit(results: DataFrame, at: Column, latency_ms: Column | None = None) -> DataFrame:
    """One tool-call event per completed search; the query is hashed, never stored."""
    return (
        results.where(F.col("status") == "ok")
        .groupBy("query_id", "agent_id", "agent_role", "session_id", "query", "pii_detected")
        .agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id"))).alias("_chunks"))
        .select(
            stable_id(F.lit("MCP_TOOL_CALL"), F.col("query_id")).alias("event_id"),
            F.lit("MCP_TOOL_CALL").alias("event_type"),
            F.lit("search_knowledge_base").alias("tool_name"),
            "agent_id",
            "agent_role",
            "session_id",
            sha256_hex(F.col("query")).alias("query_hash"),
            F.array_compact(F.transform("_chunks", lambda c: c["chunk_id"])).alias("chunk_ids"),
            "pii_detected",
            (latency_ms if latency_ms is not None else F.lit(0)).cast("int").alias("latency_ms"),
            F.lit("INFO").alias("severity"),
            at.alias("timestamp"),
        )
    )


def assemble_prompts(results: DataFrame, instruction: str = "Context:") -> DataFrame:
    """One prompt per query that returned something, from its ordered protected chunks and its safe query."""
    ordered = (
        results.where((F.col("status") == "ok") & (F.col("position") > 0))
        .groupBy("query_id", "agent_id", "agent_role", "session_id", "query")
        .agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("_chunks"))
    )
    lines = F.array_join(
        F.transform(
            "_chunks", lambda c: F.concat(F.lit("["), c["position"], F.lit("] "), c["text"])
        ),
        "\n",
    )
    return ordered.withColumn(
        "prompt", F.concat(F.lit(f"{instruction}\n"), lines, F.lit("\nQuestion: "), F.col("query"))
    ).drop("_chunks")


def fetch_documents(requests: DataFrame, documents: DataFrame, text: str, rules: RuleSet) -> DataFrame:
    """Documents by id, shielded for the caller's role.

    Row security holds here as in a search: where the registry has ``data_class`` and ``is_active``, restricted
    and inactive documents are refused with the same error as missing ones, so a caller cannot tell which ids
    exist. ``title`` and ``metadata`` are returned where the registry has them.
    """
    guarded = {"data_class", "is_active"} <= set(documents.columns)
    open_ones = visible_rows(documents) if guarded else documents
    extra = [c for c in ("title", "metadata") if c in documents.columns]
    looked_up = balanced_join(
        requests, open_ones.select("document_id", text, *extra), ["document_id"], "left"
    ).withColumn("_missing", F.col(text).isNull())
    checked = shield(looked_up, text, rules, "agent_role")
    return checked.withColumn("error", F.when(F.col("_missing"), DOCUMENT_REFUSED)).select(
        *requests.columns,
        "error",
        "status",
        F.col("safe_text").alias("content"),
        F.col("was_modified").alias("pii_masked"),
        *extra,
    )


def fetch_audit(fetched: DataFrame, key: str, at: Column) -> DataFrame:
    """One tool-call event per document asked for, refused ones included; no text."""
    return fetched.select(
        stable_id(F.lit("MCP_TOOL_CALL"), F.lit("get_document"), F.col(key)).alias("event_id"),
        F.lit("MCP_TOOL_CALL").alias("event_type"),
        F.lit("get_document").alias("tool_name"),
        "agent_role",
        F.when(F.col("error").isNull(), F.array("document_id"))
        .otherwise(F.array().cast("array<string>"))
        .alias("chunk_ids"),
        F.col("pii_masked").alias("pii_detected"),
        F.when((F.col("status") == "blocked") | F.col("error").isNotNull(), "WARNING").otherwise("INFO").alias("severity"),
        at.alias("timestamp"),
    )


def retrieval_quality(
    answered: DataFrame, query: str, answer: str, contexts: str, gate: float = 0.70
) -> DataFrame:
    """Lexical stand-ins for the four retrieval scores, the gate and its recommendation.

    ``contexts`` is the ordered array of chunks given to the model. Scores are shares of distinct
    words; precision weighs relevant chunks by their rank. A trained judge can replace them.
    """
    measured = answered.withColumns(
        {
            "_q": F.array_distinct(words(sqltext.name(query))),
            "_a": F.array_distinct(words(sqltext.name(answer))),
            "_c": F.expr(f"transform({sqltext.name(contexts)}, c -> array_distinct({words_of('c')}))"),
        }
    ).withColumns(
        {
            "_all": F.expr("array_distinct(flatten(_c))"),
            "_hits": F.expr("transform(_c, c -> arrays_overlap(c, _q))"),
        }
    )

    def share(part: str, whole: str) -> Column:
        return F.expr(
            f"round(CASE WHEN size({whole}) > 0 "
            f"THEN size(array_intersect({part}, {whole})) / size({whole}) ELSE 0D END, 3)"
        )

    precision = F.expr(
        """round(CASE WHEN exists(_hits, h -> h) THEN
             aggregate(
               transform(_hits, (h, i) -> CASE WHEN h
                 THEN size(filter(slice(_hits, 1, i + 1), x -> x)) / (i + 1) ELSE 0D END),
               0D, (total, gain) -> total + gain) / size(filter(_hits, h -> h))
           ELSE 0D END, 3)"""
    )
    scored = measured.withColumns(
        {
            "num_chunks": F.size(contexts),
            "faithfulness": share("_all", "_a"),
            "answer_relevancy": share("_a", "_q"),
            "context_precision": precision,
            "context_recall": share("_all", "_q"),
        }
    )
    weakest = F.least("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    return (
        scored.withColumn(
            "quality_gate", F.when(weakest >= gate, "PASS").otherwise("REVIEW_REQUIRED")
        )
        .withColumn(
            "recommendation",
            F.when(
                F.col("quality_gate") == "PASS", "Retrieval quality meets threshold for agent use."
            ).otherwise("Review chunking strategy or re-ranking configuration."),
        )
        .drop("_q", "_a", "_c", "_all", "_hits")
    )
