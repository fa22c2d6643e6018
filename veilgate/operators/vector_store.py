"""Embeddings that are computed once: a content-addressed store of vectors by model and text key.

The store has a folder per model and, below it, one per run that added to it (``part``; stores of old have one per first
digit of the key, which are read alike). A run takes the distinct keys of its texts, drops those that an anti join with
the keys of the store finds (neither texts nor vectors are shuffled for that), embeds the rest, adds it, and joins the
vectors, or what is read of them, to all copies of their texts. Vectors are written as they are made, without a sort. On
disk are the store, the keys of each run and, while they are embedded, the texts that were lacking.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.text import embedding_key
from veilgate.operators.keyed import balanced_join
from veilgate.session import freed_shuffles, settle
from veilgate.sources.sinks import exists

#: Rows from which the copies of one text are joined apart.
HEAVY = 100_000
#: Bits of the bitmap of lacking keys, for each and in all (32 MB); with more keys than fit it rules out fewer texts.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
MISMATCH = "embedding dimension mismatch"
STORED = "key string, dimension int, embedding array<float>, model string, part string"


def stored(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """The vectors of the store, of one model or of all."""
    if not exists(spark, folder):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(folder)
    return rows if model is None else rows.where(F.col("model") == model)


def missing(keys: DataFrame, folder: str, model: str) -> DataFrame:
    """The rows of ``keys(key, ...)`` whose key the store does not hold for this model."""
    return keys.join(stored(keys.sparkSession, folder, model).select("key"), "key", "left_anti")


def embed_stored(
    df: DataFrame, text: str, embed: Callable[[Column], Column], folder: str, model: str, dimension: int, out: str = "embedding",
    read: dict[str, Callable[[Column], Column]] | None = None,
) -> tuple[DataFrame, int]:
    """(``df`` with the vector of each row's text, number of texts embedded).

    Texts with the same key share a vector. Only keys the store lacks for ``model`` are embedded; a vector of another
    length than ``dimension`` fails the job before anything is stored. Null texts have no vector.
    ``read`` has, by name, what is wanted of a vector instead of the column ``out``: it is taken where the store is read, so
    the join moves no whole vectors.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_key", embedding_key(F.col(text)))  # null where the text is
    rows = keyed.where(F.col(text).isNotNull()).select(F.col("_key").alias("key"), F.col(text).alias("_text"))
    with freed_shuffles(spark):
        keys = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "keys")
        lacking = settle(missing(keys.select("key"), folder, model), "lacking")
        count = lacking.count()
        if count:
            _add(_least_texts(rows, lacking, count), embed, folder, model, dimension)
    hot = keys.where(F.col("rows") > HEAVY).select(F.col("key").alias("_key"))
    wanted = read or {out: lambda vector: vector}
    vectors = stored(spark, folder, model).select(F.col("key").alias("_key"), *[of(F.col("embedding")).alias(name) for name, of in wanted.items()])
    return balanced_join(keyed.drop(*wanted), vectors, ["_key"], "left", hot=hot).drop("_key"), count


def _least_texts(rows: DataFrame, lacking: DataFrame, count: int) -> DataFrame:
    """(key, _text): the least text of each of the ``count`` keys of ``lacking(key)``.

    The keys join the texts as rows without text, so one aggregation, combined before the shuffle, is both minimum and semi join.
    """
    marks = lacking.select("key", F.lit(None).cast(rows.schema["_text"].dataType).alias("_text"), F.lit(True).alias("_lacks"))
    both = _likely(rows, lacking, count).withColumn("_lacks", F.lit(False)).unionByName(marks)
    least = both.groupBy("key").agg(F.min("_text").alias("_text"), F.max("_lacks").alias("_lacks"))
    return least.where("_lacks").drop("_lacks")


def _likely(rows: DataFrame, lacking: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be among ``lacking``: all that are, and few others, whose texts then need no shuffle.

    Every task gets a bitmap of the keys' hashes, in pieces of 4 KB.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(min(count * BITS_PER_KEY, MOST_BITS))) + 1
    bit = F.bitmap_bit_position(place)
    piece = F.coalesce(F.bitmap_bucket_number(place), F.lit(0))  # never null, or a filter would evaluate the key once more
    pieces = lacking.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("_piece", piece).join(F.broadcast(pieces), "_piece")
    return met.where(F.bit_get(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def _add(texts: DataFrame, embed: Callable[[Column], Column], folder: str, model: str, dimension: int) -> None:
    """Embed ``texts(key, _text)`` and add their vectors to the store; one of a wrong length fails the job, which then commits nothing.

    They go to a folder of their own: as partition columns, model and part would have every vector sorted, and spilled, before it is written.
    """
    wrong = F.lit(f"{MISMATCH}: expected {dimension}, got ")

    def checked(vector: Column) -> Column:
        n = F.size(vector)
        error = F.raise_error(F.concat(wrong, F.coalesce(n.cast("string"), F.lit("none")))).cast("array<float>")
        return F.when(n.eqNullSafe(dimension), vector).otherwise(error)

    vector = F.element_at(F.transform(F.array(embed(F.col("_text")).cast("array<float>")), checked), 1)  # embedded once, as the one element
    made = texts.select("key", F.lit(dimension).alias("dimension"), vector.alias("embedding"))
    named = texts.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("model", model)
    try:
        made.write.option("compression", "zstd").parquet(f"{folder}/{named}/part={uuid.uuid4().hex}")
    except Exception as failed:
        found = re.search(rf"{MISMATCH}: expected \d+, got \S+?\b", str(failed))
        if found:
            raise ValueError(found[0]) from failed
        raise


def outdated(keys: DataFrame, folder: str, model: str) -> DataFrame:
    """Keys that have a vector of some model, but not of this one: what a change of models has to embed again."""
    spark = keys.sparkSession
    return missing(keys.join(stored(spark, folder).select("key").distinct(), "key", "left_semi"), folder, model)
