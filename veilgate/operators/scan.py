"""Exact hybrid scores inside one scan of the corpus: BM25 and cosine of each block of chunks with a batch of queries.

Both scores of a pair are computed in the same place and rounded in the same way, next to the chunk, and only
the best few per query and task leave it; pairs are never written or shuffled. A batch of queries is bounded and
travels to the scan; more queries take more scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.operators.keyed import is_small
from veilgate.operators.sparse import B, K1, corpus_statistics, query_terms
from veilgate.session import settle

#: Queries scored by one scan, and chunks scored at a time.
BATCH_QUERIES, BLOCK_CHUNKS = 1024, 1024
DIGITS = 6
#: Stands below every cosine, for pairs that lack a vector.
NO_VECTOR = -9.0

LISTS = "query_id string, chunk_id string, dense double, sparse double, side string"
COUNTS = "query_id string, side string, mark double, n long"


@dataclass
class Asked:
    """A batch of queries as the tasks need it."""

    ids: list[str]
    vectors: np.ndarray
    has_vector: np.ndarray
    domains: np.ndarray
    cutoffs: np.ndarray
    vocabulary: list[str]
    idf: np.ndarray
    of_term: list[np.ndarray]
    average: float
    marks: list[tuple[np.ndarray, np.ndarray]] | None = None


def batches(chunks: DataFrame, queries: DataFrame, text: str) -> Iterator[tuple[Asked, DataFrame]]:
    """Bounded batches of the queries, each with the chunks its filters can reach.

    Document frequencies are counted for all query terms in one aggregation over the corpus.
    """
    asked = settle(
        queries.select(
            F.col("query_id").cast("string").alias("query_id"),
            F.col(text).alias("_text"),
            "query_vector",
            "domain",
            F.col("cutoff").cast("timestamp").alias("cutoff"),
        ),
        "asked",
    )
    words = settle(query_terms(asked, "_text").select("query_id", "term"), "query-terms")
    vocabulary = words.select("term").distinct()
    used = chunks.select(F.explode(F.array_distinct("terms")).alias("term"))
    if is_small(vocabulary):
        used = used.join(F.broadcast(vocabulary), "term", "left_semi")
    frequency = used.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total, average = corpus_statistics(chunks).first()
    weights = settle(
        words.join(frequency, "term").select(
            "query_id", "term", F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
        ),
        "term-weights",
    )
    n = -(-asked.count() // BATCH_QUERIES)
    for number in range(n):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(n)) == number
        rows = asked.where(mine).drop("_text").orderBy("query_id").toPandas()
        terms = weights.where(mine).toPandas()
        if rows.empty:
            continue
        reachable = chunks
        wanted = sorted(set(rows["domain"].dropna()))
        if "all" not in wanted:
            reachable = reachable.where(F.col("domain").isin(*wanted))
        if rows["cutoff"].notna().all():
            reachable = reachable.where(F.col("updated_at") >= F.lit(rows["cutoff"].min()))
        yield _packed(rows, terms, average or 1.0), reachable


def _packed(rows: pd.DataFrame, terms: pd.DataFrame, average: float) -> Asked:
    has_vector = rows["query_vector"].notna().to_numpy()
    width = max((len(v) for v in rows["query_vector"] if v is not None), default=0)
    vectors = np.zeros((len(rows), width))
    for i, vector in enumerate(rows["query_vector"]):
        if vector is not None:
            vectors[i] = vector
    place = {q: i for i, q in enumerate(rows["query_id"])}
    vocabulary = sorted(set(terms["term"]))
    number = {t: i for i, t in enumerate(vocabulary)}
    of_term: list[list[int]] = [[] for _ in vocabulary]
    idf = np.zeros(len(vocabulary))
    for q, t, weight in zip(terms["query_id"], terms["term"], terms["idf"], strict=True):
        of_term[number[t]].append(place[q])
        idf[number[t]] = weight
    return Asked(
        rows["query_id"].tolist(),
        _unit(vectors),
        has_vector,
        rows["domain"].to_numpy(dtype=object),
        pd.to_datetime(rows["cutoff"]).to_numpy(),
        vocabulary,
        idf,
        [np.array(sorted(x)) for x in of_term],
        average,
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def blocks(parts: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(chunk ids, dense, sparse, allowed) of each block; matrices have a row per query and a column per chunk."""
    words = pa.array(asked.vocabulary, pa.string())
    for part in parts:
        for at in range(0, part.num_rows, BLOCK_CHUNKS):
            block = part.slice(at, BLOCK_CHUNKS)
            yield _scored(block, asked, words)


def _scored(block: pa.RecordBatch, asked: Asked, words: pa.Array):
    n = block.num_rows
    names, domains, updated, embeddings, terms, lengths = block.columns
    sparse = np.zeros((len(asked.ids), n))
    counts = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False)
    number = pc.index_in(terms.flatten(), value_set=words)
    number = number.fill_null(-1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), counts)
    known = number >= 0
    pair, frequency = np.unique(number[known].astype(np.int64) * n + owner[known], return_counts=True)
    term, chunk = pair // n, pair % n
    size = lengths.fill_null(0).to_numpy(zero_copy_only=False)[chunk]
    part = frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * size / asked.average))
    edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        t = term[a]
        sparse[np.ix_(asked.of_term[t], chunk[a:b])] += asked.idf[t] * part[a:b]
    dense = np.full((len(asked.ids), n), NO_VECTOR)
    there = embeddings.is_valid().to_numpy(zero_copy_only=False)
    if asked.vectors.shape[1] and there.any():
        flat = embeddings.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
        vectors = _unit(flat.astype("float64").reshape(int(there.sum()), -1))
        scores = np.round(asked.vectors @ vectors.T, DIGITS) + 0.0
        scores[~asked.has_vector] = NO_VECTOR
        dense[:, there] = scores
    domain_of = domains.to_numpy(zero_copy_only=False)
    time_of = pd.to_datetime(updated.to_pandas()).dt.tz_localize(None).to_numpy()
    allowed = np.empty((len(asked.ids), n), bool)
    masks: dict = {}
    for i, wanted in enumerate(asked.domains):
        key = (wanted, asked.cutoffs[i])
        if key not in masks:
            mask = np.ones(n, bool) if wanted == "all" else domain_of == wanted
            if not np.isnat(asked.cutoffs[i]):
                mask = mask & (time_of >= asked.cutoffs[i])
            masks[key] = mask
        allowed[i] = masks[key]
    return np.array(names.to_pylist(), dtype=str), dense, np.round(sparse, DIGITS) + 0.0, allowed


class Best:
    """The best ``depth`` chunks of one query by a first score, then a second, then the least id."""

    def __init__(self, depth: int):
        self.depth = depth
        self.first, self.second = np.empty(0), np.empty(0)
        self.names = np.empty(0, dtype="<U1")

    def add(self, first: np.ndarray, second: np.ndarray, names: np.ndarray) -> None:
        if len(self.names) == self.depth:
            a, b = self.first[-1], self.second[-1]
            near = (first > a) | ((first == a) & ((second > b) | ((second == b) & (names < self.names[-1]))))
            first, second, names = first[near], second[near], names[near]
        if not len(first):
            return
        if len(first) > 4 * self.depth:  # only ties with the cut can matter below it
            cut = np.partition(first, len(first) - self.depth)[len(first) - self.depth]
            near = first >= cut
            first, second, names = first[near], second[near], names[near]
        first, second = np.concatenate((self.first, first)), np.concatenate((self.second, second))
        names = np.concatenate((self.names, names))
        order = np.lexsort((names, -second, -first))[: self.depth]
        self.first, self.second, self.names = first[order], second[order], names[order]


def _columns(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.col("chunk_id").cast("string"), "domain", F.col("updated_at").cast("timestamp"), "embedding", "terms",
        F.col("doc_len").cast("double"),
    )


def best_lists(chunks: DataFrame, asked: Asked, depth: int, matched_only: bool = False) -> DataFrame:
    """Per query and task its ``depth`` best chunks by sparse score and by dense score, with both scores.

    Ties within a list go by the other score, then by id; chunks without a score take part with the lowest.
    With ``matched_only`` just chunks that share a term are listed, by sparse score and id.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        by_sparse = [Best(depth) for _ in asked.ids]
        by_dense = [] if matched_only else [Best(depth) for _ in asked.ids]
        for names, dense, sparse, allowed in blocks(parts, asked):
            for i in range(len(asked.ids)):
                mask = allowed[i] & (sparse[i] > 0) if matched_only else allowed[i]
                s, d, own = sparse[i][mask], dense[i][mask], names[mask]
                by_sparse[i].add(s, np.zeros(len(s)) if matched_only else d, own)
                if not matched_only:
                    by_dense[i].add(d, s, own)
        rows: dict[str, list] = {"query_id": [], "chunk_id": [], "dense": [], "sparse": [], "side": []}
        for side, lists in (("sparse", by_sparse), ("dense", by_dense)):
            for name, best in zip(asked.ids, lists, strict=False):
                d, s = (best.second, best.first) if side == "sparse" else (best.first, best.second)
                rows["query_id"] += [name] * len(s)
                rows["chunk_id"] += best.names.tolist()
                rows["dense"] += d.tolist()
                rows["sparse"] += s.tolist()
                rows["side"] += [side] * len(s)
        yield pa.RecordBatch.from_pydict(
            rows, schema=pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("dense", pa.float64()), ("sparse", pa.float64()), ("side", pa.string())])
        )

    return _columns(chunks).mapInArrow(run, LISTS)


def counts_above(chunks: DataFrame, asked: Asked) -> DataFrame:
    """Per query and task, how many visible chunks score above each of ``asked.marks`` (dense, sparse)."""
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        above = [[np.zeros(len(m) + 1, np.int64) for m in marks] for marks in asked.marks]
        for _, dense, sparse, allowed in blocks(parts, asked):
            for i, marks in enumerate(asked.marks):
                for k, scores in enumerate((dense[i], sparse[i])):
                    where = np.searchsorted(marks[k], scores[allowed[i]], side="left")
                    above[i][k] += np.bincount(where, minlength=len(marks[k]) + 1)
        rows: dict[str, list] = {"query_id": [], "side": [], "mark": [], "n": []}
        for i, name in enumerate(asked.ids):
            for k, side in enumerate(("dense", "sparse")):
                greater = np.cumsum(above[i][k][::-1])[::-1][1:]
                rows["query_id"] += [name] * len(greater)
                rows["side"] += [side] * len(greater)
                rows["mark"] += asked.marks[i][k].tolist()
                rows["n"] += greater.tolist()
        yield pa.RecordBatch.from_pydict(
            rows, schema=pa.schema([("query_id", pa.string()), ("side", pa.string()), ("mark", pa.float64()), ("n", pa.int64())])
        )

    return _columns(chunks).mapInArrow(run, COUNTS)
