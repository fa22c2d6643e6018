"""The engine's tables as views over the test tables (documents, events, customer, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.operators import postings
from veilgate.operators.corpus import chunk_documents, visible, with_terms
from veilgate.session import scratch_path

AS_OF = "2024-06-30 00:00:00"
ROLES = ("analyst", "collections-agent", "servicing-agent", "fraud-agent", "public")
DOMAINS = ("all", "en", "fr", "de", "es")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number: str) -> str:
    """SQL text choosing one of the values by a number."""
    return f"element_at(array({sqltext.texts(values)}), CAST(pmod({number}, {len(values)}) AS INT) + 1)"


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows that grow into long texts over all cores: their file is small and would be read by one task."""
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *df.columns)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Servicing notes about customers, holding every kind of detectable identifier."""

    def digits(n: int) -> str:
        return f"lpad(CAST(c_custkey % {10**n} AS STRING), {n}, '0')"

    note = f"""concat(
      'Account ENT-', {digits(10)}, ' mail user', c_custkey, '@example.com',
      ' call 415-555-', {digits(4)},
      CASE c_mktsegment
        WHEN 'BUILDING' THEN concat(' SSN ', {digits(3)}, '-45-', {digits(4)})
        WHEN 'AUTOMOBILE' THEN concat(' card 4532-0151-1283-', {digits(4)})
        WHEN 'MACHINERY' THEN concat(' acct #', {digits(12)})
        WHEN 'HOUSEHOLD' THEN concat(' ref AB-', {digits(10)}, ' ok')
        ELSE '' END)"""
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")).selectExpr(
        "concat('note:', c_custkey) AS text_id",
        f"{note} AS text",
        f"{pick(ROLES, 'c_nationkey')} AS agent_role",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of the test tables: documents, pages, conversations and notes."""
    documents = table(spark, sf_dir, "documents").selectExpr(
        "concat('doc:', doc_id) AS text_id", "text", f"{pick(ROLES, 'doc_id')} AS agent_role"
    )
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('page:', page_id) AS text_id",
        "html AS text",
        f"{pick(ROLES, 'page_id')} AS agent_role",
    )
    return documents.unionByName(pages).unionByName(turns(spark, sf_dir)).unionByName(notes(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as texts."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "concat_ws(':', 'turn', conv_id, turn) AS text_id",
        "text",
        f"{pick(ROLES, 'conv_id')} AS agent_role",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document registry with the governance columns of the chunk schema."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS document_id",
        "lang AS domain",
        "source AS source_uri",
        """CASE WHEN doc_id % 10 = 0 THEN 'RESTRICTED' WHEN doc_id % 10 < 4 THEN 'INTERNAL'
             ELSE 'STANDARD' END AS data_class""",
        "doc_id % 17 <> 0 AS is_active",
        f"TIMESTAMP '{AS_OF}' - make_dt_interval(CAST(doc_id % 120 AS INT)) AS updated_at",
        """CASE WHEN doc_id % 9 = 0 THEN 'older-model' ELSE 'current-model' END
             AS embedding_model_id""",
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk corpus: documents cut into pieces, vectors attached by document."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("document_id"), "embedding"
    )
    return chunk_documents(documents(spark, sf_dir), "document_id", "text").join(
        vectors, "document_id", "left"
    )


_INGESTED: dict[tuple, str] = {}


def ingested(spark: SparkSession, sf_dir: str, name: str, names: tuple[str, ...], write: Callable[[str], None]) -> str:
    """The folder of what ``write`` stores about some tables: written once per application and state of their files."""
    marks = []
    for one in names:
        file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        marks.append(tuple(table(spark, sf_dir, one).select(file.alias("h")).agg(F.count("*"), F.min("h"), F.max("h")).first()))
    key = (spark.sparkContext.applicationId, name, sf_dir, *marks)
    if key not in _INGESTED:
        folder = scratch_path(spark, name)
        write(folder)
        _INGESTED[key] = folder
    return _INGESTED[key]


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible chunks with their terms, ingested once so that searches read stored columns."""
    found = with_terms(visible(chunks(spark, sf_dir)), "chunk_text")
    folder = ingested(spark, sf_dir, "chunks", ("documents", "embeddings"), found.write.parquet)
    return spark.read.schema(found.schema).parquet(folder)


def term_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the inverted index of the visible chunks."""
    return ingested(
        spark, sf_dir, "term-index", ("documents", "embeddings"), lambda folder: postings.append(search_corpus(spark, sf_dir), folder)
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: benchmark passages with the vector of the same number."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS item_id", "embedding AS query_vector"
    )
    return (
        table(spark, sf_dir, "benchmark")
        .join(vectors, "item_id", "left")
        .selectExpr(
            "CAST(item_id AS STRING) AS query_id",
            "text AS query",
            "query_vector",
            f"{pick(DOMAINS, 'item_id')} AS domain",
            f"""TIMESTAMP '{AS_OF}' - make_dt_interval(CAST(30 + (item_id % 4) * 30 AS INT))
                  AS cutoff""",
            "CAST(item_id % 6 + 1 AS INT) AS top_k",
            "concat('agent-', item_id % 7) AS agent_id",
            f"{pick(ROLES, 'item_id')} AS agent_role",
            "concat('session-', item_id % 11) AS session_id",
        )
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts: every conversation turn and every servicing note, with a session."""
    return (
        turns(spark, sf_dir)
        .unionByName(notes(spark, sf_dir))
        .selectExpr(
            "text_id AS prompt_id",
            "text AS prompt",
            "concat('agent-', agent_role) AS agent_id",
            "agent_role",
            "concat('session-', substring(md5(text_id), 1, 4)) AS session_id",
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses: all texts, as if a model had repeated them."""
    return texts(spark, sf_dir).selectExpr(
        "text_id AS response_id",
        "text AS response",
        "concat('agent-', agent_role) AS agent_id",
        "concat('session-', substring(md5(text_id), 1, 4)) AS session_id",
    )


AUDIT_TOOLS = {
    "view": "search_knowledge_base",
    "click": "get_document_context",
    "purchase": "get_entity_context",
    "signup": "get_entity_token",
    "error": "search_entity_history",
}
AUDIT_ROLES = (
    "analyst",
    "collections-agent",
    "servicing-agent",
    "fraud-agent",
    "ml-service",
    "model-risk",
    "visitor",
)


def audit_columns(events: DataFrame) -> DataFrame:
    """Audit records from the event table; works on a static and on a streaming frame."""
    tools = " ".join(f"WHEN '{kind}' THEN '{tool}'" for kind, tool in AUDIT_TOOLS.items())
    none = "CAST(array() AS array<string>)"
    numbered = events.withColumns(
        {
            "k": F.expr("CAST(get_json_object(props, '$.k') AS INT)"),
            "agent_id": F.expr("concat('agent-', lpad(CAST(user_id AS STRING), 6, '0'))"),
        }
    )
    return numbered.selectExpr(
        "concat('evt-', event_id) AS event_id",
        """CASE WHEN k >= 98 THEN 'PII_LEAKAGE' WHEN k >= 95 THEN 'PROMPT_BLOCKED'
             WHEN k >= 90 THEN 'PII_BLOCKED' WHEN k >= 80 THEN 'PII_PROCESSED'
             ELSE 'MCP_TOOL_CALL' END AS event_type""",
        f"CASE event_type {tools} ELSE 'evaluate_retrieval_quality' END AS tool_name",
        "agent_id",
        f"{pick(AUDIT_ROLES, 'user_id')} AS agent_role",
        "concat(agent_id, '-', date_format(ts, 'yyyyMMdd')) AS session_id",
        "sha2(concat('query ', event_id), 256) AS query_hash",
        "array(concat(event_id div 10, ':0'), concat(event_id div 20, ':0')) AS chunk_ids",
        "k % 4 = 0 AS pii_detected",
        f"""CASE WHEN k % 4 <> 0 THEN {none}
              WHEN k >= 90 THEN array('US_SSN', 'EMAIL_ADDRESS')
              WHEN k % 8 = 0 THEN array('EMAIL_ADDRESS', 'PHONE_NUMBER')
              ELSE array('ACCOUNT_NUMBER') END AS pii_entity_types""",
        f"""CASE WHEN k % 4 <> 0 THEN {none} WHEN k >= 90 THEN array('block', 'mask')
              WHEN k % 8 = 0 THEN array('mask', 'mask') ELSE array('token') END
              AS pii_modes_applied""",
        "CAST(floor(value * 10) AS INT) AS latency_ms",
        """CASE WHEN k >= 98 THEN 'CRITICAL' WHEN k >= 90 THEN 'HIGH' WHEN k >= 80 THEN 'WARNING'
             ELSE 'INFO' END AS severity""",
        "CAST(ts AS TIMESTAMP) AS timestamp",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_columns(table(spark, sf_dir, "events"))


def token_of(key: str) -> str:
    """SQL text of the entity token of a customer key in the session of the tests."""
    seed = f"concat('sess-001:internal_id:', {key})"
    return f"concat('TOK_', upper(substring(sha2({seed}, 256), 1, 16)))"


FEATURE_SETS_BY_PRIORITY = {
    "1-URGENT": "credit_risk",
    "2-HIGH": "churn_risk",
    "3-MEDIUM": "collections_propensity",
}


def feature_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature values over time: one row per order of a customer."""
    sets = " ".join(f"WHEN '{p}' THEN '{name}'" for p, name in FEATURE_SETS_BY_PRIORITY.items())
    return table(spark, sf_dir, "orders").selectExpr(
        f"{token_of('o_custkey')} AS entity_token",
        f"CASE o_orderpriority {sets} ELSE 'cross_sell' END AS feature_set",
        "CAST(o_orderdate AS TIMESTAMP) AS as_of",
        "o_orderkey AS version",
        "o_totalprice / 600000 AS value_1",
        "CAST(o_orderkey % 97 AS DOUBLE) AS value_2",
        "CAST(o_orderkey % 90 AS DOUBLE) AS value_3",
        "CAST(o_orderkey % 5 + 1 AS DOUBLE) AS value_4",
    )
