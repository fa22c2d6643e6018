"""Exact vector search: block-wise matrix products inside Spark tasks.

Only the best ``depth`` chunks per query leave a task, so the pairs of queries and chunks are
never materialised. Small query tables are sent to the scan of the corpus; larger ones are cut
into tiles together with the corpus and meet in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgate.session import settle

PACKED_QUERIES = 4_096
TILE_CHUNKS = 50_000
DIGITS = 6
EVERYTHING = -2.0
#: Scores that a task holds at a time.
CELLS = 4_000_000

HITS = "query_id string, chunk_id string, dense double, n long, cut_ties long"


class BlockTop:
    """Best chunks per query over the blocks seen so far, plus counts above given scores."""

    def __init__(self, queries: pd.DataFrame, depth: int):
        matrix = np.array(queries["query_vector"].tolist(), dtype="float64")
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
        self.ids = queries["query_id"].tolist()
        self.domains = queries["domain"].to_numpy(dtype=object)
        self.cutoffs = pd.to_datetime(queries["cutoff"]).to_numpy()
        self.marks = [
            np.unique(np.append(np.asarray(m if m is not None else [], dtype="float64"), EVERYTHING))
            for m in queries["marks"]
        ]
        self.above = [np.zeros(len(m) + 1, dtype="int64") for m in self.marks]
        self.depth = depth
        self.best = [(np.empty(0), np.empty(0, dtype=object), 0) for _ in self.ids]
        # what a score has to reach: the last one kept of a query that has ``depth`` of them
        self.floor = np.full(len(self.ids), -np.inf)
        self.open = np.ones(len(self.ids), bool)
        self.plain = np.array([len(m) == 1 for m in self.marks], bool)

    def add(self, block: pd.DataFrame) -> None:
        """Take in a block, a slice at a time, so that the scores in memory do not grow with it."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for start in range(0, len(block), step):
            self._add(block.iloc[start : start + step])

    def _add(self, block: pd.DataFrame) -> None:
        vectors = np.array(block["embedding"].tolist(), dtype="float64")
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
        scores = self.matrix @ vectors.T
        np.round(scores, DIGITS, out=scores)
        scores += 0.0
        names = block["chunk_id"].to_numpy(dtype=object)
        domains = block["domain"].to_numpy(dtype=object)
        updated = pd.to_datetime(block["updated_at"]).to_numpy()
        # a query without marks of its own that no score of the slice reaches only counts the rows it may see
        reached = self.open | (scores >= self.floor[:, None]).any(axis=1)
        masks: dict = {}
        for i, wanted in enumerate(self.domains):
            key = (wanted, self.cutoffs[i])
            if key not in masks:
                allowed = np.ones(len(names), bool) if wanted == "all" else domains == wanted
                if not np.isnat(self.cutoffs[i]):
                    allowed = allowed & (updated >= self.cutoffs[i])
                masks[key] = (allowed, int(allowed.sum()))
            allowed, n = masks[key]
            if self.plain[i]:
                self.above[i][1] += n
            if n and (reached[i] or not self.plain[i]):
                self._merge(i, scores[i][allowed], names[allowed])

    def _merge(self, i: int, scores: np.ndarray, names: np.ndarray) -> None:
        if not self.plain[i]:
            marks = self.marks[i]
            self.above[i] += np.bincount(
                np.searchsorted(marks, scores, side="left"), minlength=len(marks) + 1
            )
        kept_scores, kept_names, cut = self.best[i]
        full = len(kept_scores) == self.depth
        if full:
            floor = kept_scores[-1]
            near = scores >= floor
            scores, names = scores[near], names[near]
            if not len(scores):
                return
        all_scores = np.concatenate([kept_scores, scores])
        all_names = np.concatenate([kept_names, names])
        order = np.lexsort((all_names.astype(str), -all_scores))
        chosen, rest = order[: self.depth], order[self.depth :]
        new_scores = all_scores[chosen]
        floor = new_scores[-1]
        same_floor = full and floor == kept_scores[-1]
        cut = (cut if same_floor else 0) + int((all_scores[rest] == floor).sum())
        self.best[i] = (new_scores, all_names[chosen], cut)
        if len(new_scores) == self.depth:
            self.floor[i], self.open[i] = floor, False

    def rows(self) -> pd.DataFrame:
        query, chunk, dense, count, ties = [], [], [], [], []
        for i, name in enumerate(self.ids):
            scores, names, cut = self.best[i]
            query += [name] * len(scores)
            chunk += names.tolist()
            dense += scores.tolist()
            count += [None] * len(scores)
            ties += [0] * (len(scores) - 1) + [cut] if len(scores) else []
            greater = np.cumsum(self.above[i][::-1])[::-1][1:]
            query += [name] * len(greater)
            chunk += [None] * len(greater)
            dense += self.marks[i].tolist()
            count += greater.tolist()
            ties += [0] * len(greater)
        return _hits_frame(query, chunk, dense, count, ties)


def _hits_frame(query: list, chunk: list, dense: list, count: list, ties: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query_id": pd.Series(query, dtype=object),
            "chunk_id": pd.Series(chunk, dtype=object),
            "dense": pd.Series(dense, dtype="float64"),
            "n": pd.array(count, dtype="Int64"),
            "cut_ties": pd.Series(ties, dtype="int64"),
        }
    )


def score_hits(corpus: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """Best chunks per query and task, and how many chunks score above each query's ``marks``.

    ``corpus``: chunk_id, embedding, domain, updated_at. ``queries``: query_id, query_vector,
    domain (``all`` for any), cutoff (nullable), marks (array of scores, nullable).
    Rows with a chunk are candidates; rows without one carry a count in ``n``.
    """
    asked = queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        "query_vector",
        "domain",
        F.col("cutoff").cast("timestamp").alias("cutoff"),
        "marks",
    ).where(F.col("query_vector").isNotNull())
    vectors = corpus.select("chunk_id", "embedding", "domain", "updated_at").where(
        F.col("embedding").isNotNull()
    )
    if asked.count() <= PACKED_QUERIES:
        return settle(_packed(vectors, asked.toPandas(), depth), "hits")
    return settle(_tiled(vectors, asked, depth), "hits")


def _packed(vectors: DataFrame, packed: pd.DataFrame, depth: int) -> DataFrame:
    wanted = sorted(set(packed["domain"]))
    if "all" not in wanted:
        vectors = vectors.where(F.col("domain").isin(*wanted))
    if len(packed) and packed["cutoff"].notna().all():
        vectors = vectors.where(F.col("updated_at") >= F.lit(packed["cutoff"].min()))
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def scan(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = None
        for block in blocks:
            if len(block):
                if top is None:
                    top = BlockTop(shared.value, depth)
                top.add(block)
        if top is not None:
            yield top.rows()

    if packed.empty:
        return vectors.sparkSession.createDataFrame([], HITS)
    return vectors.mapInPandas(scan, HITS)


def _tiled(
    vectors: DataFrame,
    asked: DataFrame,
    depth: int,
    query_tiles: int | None = None,
    chunk_tiles: int | None = None,
) -> DataFrame:
    query_tiles = query_tiles or -(-asked.count() // PACKED_QUERIES)
    chunk_tiles = chunk_tiles or -(-vectors.count() // TILE_CHUNKS) or 1
    return _cogrouped(
        vectors.withColumn("_c", F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_tiles)).cast("int"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1)))),
        asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)).cast("int"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunk_tiles - 1)))),
        ["_c", "_q"],
        depth,
    )


def _cogrouped(vectors: DataFrame, asked: DataFrame, keys: list[str], depth: int) -> DataFrame:
    def tile(chunks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(chunks):
            return _hits_frame([], [], [], [], [])
        top = BlockTop(queries, depth)
        top.add(chunks)
        return top.rows()

    return (
        vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(tile, HITS)
    )


def best_of(hits: DataFrame, depth: int) -> DataFrame:
    """Top ``depth`` candidates per query with their ``dense_rank`` (ties share a rank).

    ``overflow`` marks queries that have further chunks tied with the last candidate.
    """
    best_first = Window.partitionBy("query_id").orderBy(F.desc("dense"), "chunk_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("dense"))
    equals = Window.partitionBy("query_id", "dense")
    return (
        hits.where(F.col("chunk_id").isNotNull())
        .withColumn("_ties", F.count(F.lit(1)).over(equals) + F.sum("cut_ties").over(equals))
        .withColumn("_position", F.row_number().over(best_first))
        .where(F.col("_position") <= depth)
        .withColumn("dense_rank", F.rank().over(by_score).cast("long"))
        .withColumn(
            "overflow",
            F.col("dense_rank") - 1 + F.col("_ties") > F.lit(depth),
        )
        .select("query_id", "chunk_id", "dense", "dense_rank", "_position", "overflow")
    )


def dense_top(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k chunks per query by cosine similarity (6 digits, ties by chunk id)."""
    hits = score_hits(corpus, queries.withColumn("marks", F.lit(None).cast("array<double>")), k)
    return best_of(hits, k).withColumnRenamed("_position", "position").drop("overflow")


def dense_top_clustered(
    corpus: DataFrame, queries: DataFrame, k: int, centroids: int = 16, probes: int = 4, seed: int = 7
) -> DataFrame:
    """Approximate top-k: each query looks only into its ``probes`` nearest clusters.

    Clusters are cut into sub-blocks of bounded size, and so are the queries, so a cluster that
    attracts a third of the corpus is spread over as many tasks as it needs.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = corpus.select("chunk_id", "embedding", "domain", "updated_at").where(
        F.col("embedding").isNotNull()
    )
    model = KMeans(
        k=centroids, seed=seed, maxIter=10, featuresCol="_v", predictionCol="_q"
    ).fit(vectors.select(array_to_vector("embedding").alias("_v")))
    centres = np.array(model.clusterCenters())
    placed = (
        model.transform(vectors.withColumn("_v", array_to_vector("embedding")))
        .drop("_v")
        .withColumn("_q", F.col("_q").cast("int"))
    )
    blocks = -(-placed.groupBy("_q").count().agg(F.max("count")).first()[0] // TILE_CHUNKS)

    @F.pandas_udf("array<int>")
    def nearest(queries_: pd.Series) -> pd.Series:
        matrix = np.array(queries_.tolist(), dtype="float64")
        gaps = ((matrix[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        return pd.Series(np.argsort(gaps, axis=1, kind="stable")[:, :probes].tolist())

    asked = (
        queries.where(F.col("query_vector").isNotNull())
        .select(
            F.col("query_id").cast("string").alias("query_id"),
            "query_vector",
            "domain",
            F.col("cutoff").cast("timestamp").alias("cutoff"),
            F.lit(None).cast("array<double>").alias("marks"),
        )
        .withColumn("_q", F.explode(nearest("query_vector")))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    query_tiles = -(-queries.count() // PACKED_QUERIES) or 1
    asked = asked.withColumn("_s", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)).cast("int"))
    placed = placed.withColumn(
        "_c", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
    ).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    hits = settle(_cogrouped(placed, asked, ["_q", "_c", "_s"], k))
    return best_of(hits, k).withColumnRenamed("_position", "position").drop("overflow")
