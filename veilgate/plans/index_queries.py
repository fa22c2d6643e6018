"""Queries over stored indexes: built once below the shared folder, then read by what a search needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions import vectors
from veilgate.functions.text import embedding_key
from veilgate.operators import dense, ivf, vector_store
from veilgate.plans import tables as T
from veilgate.plans.search_oracles import KEY, TEXTS, component, cosine
from veilgate.session import scratch_path, settle

K = 10
#: Recall that the vector index has to reach.
RECALL = 0.9


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    rows = T.table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.lit("en").alias("domain"), none.alias("updated_at"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose number is divisible by 50, as a query against all."""
    rows = _vectors(spark, sf).where("CAST(chunk_id AS BIGINT) % 50 = 0")
    none = F.lit(None).cast("timestamp")
    return rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit("all").alias("domain"), none.alias("cutoff"))


def ann_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The exact nearest vectors, which the index is measured by."""
    return dense.dense_top(_vectors(spark, sf), _asked(spark, sf), K)


def ann_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors by the stored index, in the lists each query probes."""
    folder = scratch_path(spark, "vector-index")
    if ivf.build(_vectors(spark, sf), folder, k=K) is None:
        return ann_exact(spark, sf)
    return ivf.search(spark, folder, _asked(spark, sf), K)


def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the exact nearest vectors the index finds, and whether that is enough."""
    exact = settle(ann_exact(spark, sf).select("query_id", "chunk_id"), "exact")
    found = ann_index_topk(spark, sf).select("query_id", "chunk_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "chunk_id"], "left").agg(
        F.countDistinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_exact"),
        (F.count("found") >= RECALL * F.count(F.lit(1))).alias("reached"),
    )


def embed_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of full width from the store: documents first, then all texts, then all again, with what each run embedded."""
    folder, texts = scratch_path(spark, "vectors"), T.texts(spark, sf)
    width, counts = vectors.MODEL_DIMENSIONS[vectors.DEFAULT_MODEL], []
    read = {
        "dimension": F.size,
        "first": lambda vector: F.element_at(vector, 1).cast("double"),
        "last": lambda vector: F.element_at(vector, -1).cast("double"),
    }
    for rows in (texts.where("text_id LIKE 'doc:%'"), texts, texts):
        found, new = vector_store.embed_stored(
            rows, "text", lambda t: vectors.pseudo_components(embedding_key(t), width), folder, vectors.DEFAULT_MODEL, width, read=read
        )
        counts.append(F.lit(new).cast("long"))
    return found.select("text_id", *read, *[count.alias(name) for count, name in zip(counts, ("new_documents", "new_others", "new_again"), strict=True)])


QUERIES = {query.__name__: query for query in (ann_exact, ann_index_topk, ann_recall, embed_store)}

_EXACT = f"""
WITH vectors AS (SELECT vec_id, vec_id::VARCHAR AS chunk_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.chunk_id AS query_id, c.chunk_id, {cosine('c.embedding', 'q.embedding')} AS dense
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0),
top AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY dense DESC) AS dense_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS position
  FROM pairs QUALIFY position <= {K})"""

ORACLES = {
    "ann_exact": f"{_EXACT} SELECT * FROM top",
    "embed_store": f"""WITH {TEXTS}, keyed AS (SELECT text_id, {KEY} AS key FROM texts),
counts AS (
  SELECT count(DISTINCT key) FILTER (text_id LIKE 'doc:%') AS new_documents, count(DISTINCT key) AS everything FROM keyed)
SELECT text_id, CASE WHEN key IS NULL THEN NULL ELSE 1536 END::INT AS dimension, {component('key', 1)}::DOUBLE AS first,
  (('0x' || substr(sha256(key || ':95'), 61, 4))::INT / 32768.0 - 1.0)::DOUBLE AS last,
  new_documents, everything - new_documents AS new_others, 0::BIGINT AS new_again FROM keyed, counts""",
    "ann_recall": f"{_EXACT} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS reached FROM top",
}
