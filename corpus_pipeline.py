"""The corpus pipeline: documents are judged, thinned out, decontaminated and turned into token ids.

Each stage works on all rows its predecessor kept and takes effect: all but the last return the columns of
documents for the rows that stay. ``run`` writes every stage as Parquet below the shared folder and reads it
again, so a lost executor repeats one stage at most. SQL can express none of it as a whole (boosted trees,
SimHash, alignment, BPE), so ``ORACLE_SQL`` is None and tests compare each stage with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.llm import byte_bpe, decontaminate, golay_dedup, quality, similar_texts
from veilgate.llm.common import table, unused
from veilgate.llm.components import connected_components
from veilgate.session import settle

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier scores at 0.5 or more; the model is fitted on the labelled ones among them."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    into = unused(docs.columns, "score")
    return quality.score(docs, forest, into=into).where(F.col(into) >= 0.5).drop(into)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of near-duplicates.

    A group is connected by SimHash links of the contract (4-word shingles, at most 4 bits) and by near copies (5-word
    shingles, similarity 0.8 or more) that bands of minimum hashes bring together. Documents without an id
    get a key from a hash of their text that sorts after all real ids, so they stay unless they are copies. Of rows that
    repeat an id with different texts that with the least hash has the id as its key and the others have keys of their
    own behind the real ids, so only copies are dropped; of rows equal in id and text that with the least hash of all
    its columns stays. The columns of documents travel as one struct, so their names and types do not matter.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    text, number = F.coalesce(F.col("document.text").cast("string"), F.lit("")), F.col("document.doc_id").cast("long")
    digest = F.xxhash64(text)
    named = whole.select(number.alias("number"), digest.alias("digest")).where("number IS NOT NULL")
    repeated = named.groupBy("number").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    repeated = settle(repeated.where("least <> most").select("number", "least"), "repeated-ids")
    spare = F.lit(1 << 62) + F.col("digest").bitwiseAND((1 << 61) - 1)
    other = F.lit(1 << 61) + F.xxhash64("number", text).bitwiseAND((1 << 61) - 1)
    rows = whole.select("document", number.alias("number"), digest.alias("digest"))
    rows = rows.withColumn("least", F.lit(None).cast("long")) if repeated.isEmpty() else rows.join(repeated, "number", "left")
    key = F.when(F.col("least") != F.col("digest"), other).otherwise(F.coalesce("number", spare))
    keyed = rows.select(key.alias("key"), text.alias("text"), "document")
    same, near = similar_texts.similar_links(keyed, id_col="key")
    edges = (
        golay_dedup.document_links(keyed, id_col="key")
        .unionByName(near)
        .unionByName(same.selectExpr("id AS u", "rep AS v"))
    )
    gone = connected_components(edges).where("node <> root").select(F.col("node").alias("key"))
    parts = [F.to_json(f"document.`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"document.`{f.name}`") for f in docs.schema]
    left = keyed.join(gone, "key", "left_anti").select("key", "document", F.xxhash64(*parts).alias("rank"))
    return left.groupBy("key").agg(F.min_by("document", "rank").alias("document")).select("document.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    into = unused(docs.columns, "leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), into=into)
    return found.where(F.size(into) == 0).drop(into)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and digests of ids and decoded bytes."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.encode_decode(docs, vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.digests(tokens, keep_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
