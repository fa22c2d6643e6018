"""BM25 over a stored inverted index: posting blocks per term, with bounds that let a search skip blocks.

Chunks of one month and domain are numbered in segments of at most SEGMENT. A posting block holds, for one term and
segment, the numbers, frequencies, lengths and times of the chunks with that term, and its latest time, greatest frequency
and least length, which bound what the term can add to a score there. Blocks lie in folders of their month, sorted by term, so a search
reads the blocks of its terms. It adds up the bounds of a segment for all its queries at once and scores it
only for queries whose best results so far it could still change. What a day brings is appended; statistics add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.operators.sparse import B, DIGITS, K1, query_terms
from veilgate.session import settle

#: Chunks of a segment, queries answered by one scan, and terms of a scan that are pushed to the files one by one.
SEGMENT, BATCH_QUERIES, PUSHED_TERMS = 1024, 1024, 2000
#: Stands for the time of chunks without one, which no cutoff lets pass.
NO_TIME = -(1 << 63)

BLOCKS = (
    "month string, segment long, domain string, term string, docs array<int>, tfs array<int>, lens array<int>, times array<long>, "
    "latest long, max_tf int, min_len int, n int, chunk_ids array<string>, total long"
)
FOUND = "query_id string, segment long, doc int, sparse double"


# building ---------------------------------------------------------------------------------------------


def _segment(month, domain, ids: list[str], times: np.ndarray, terms: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """The posting blocks of some chunks, then one row with their ids."""
    n = len(ids)
    length = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = hashlib.blake2b(f"{month}|{domain}|{ids[0]}|{ids[-1]}|{n}".encode(), digest_size=8).digest()
    segment = int.from_bytes(named, "little", signed=True)
    words = terms.flatten().dictionary_encode()
    code, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    doc = code % n
    starts = np.flatnonzero(np.diff(code // n, prepend=-1))
    ends = np.append(starts, len(code)).astype(np.int32)
    rows = len(starts)
    lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((doc, pa.int32()), (tf, pa.int32()), (length[doc], pa.int32()), (times[doc], pa.int64()))]
    if rows:
        yield _blocks(
            rows, month, domain, segment, words.dictionary.take(pa.array(code[starts] // n)), *lists,
            np.maximum.reduceat(times[doc], starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(length[doc], starts), np.diff(ends), None, None,
        )
    nothing = [None] * 4
    yield _blocks(1, month, domain, segment, [None], *([x] for x in nothing), [None], [None], [None], [n], [ids], [int(length.sum())])


def _blocks(rows: int, month, domain, segment, term, docs, tfs, lens, times, latest, max_tf, min_len, n, ids, total) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    columns = [
        ("month", [month] * rows, pa.string()), ("segment", [segment] * rows, pa.int64()), ("domain", [domain] * rows, pa.string()),
        ("term", term, pa.string()), ("docs", docs, ints), ("tfs", tfs, ints), ("lens", lens, ints), ("times", times, pa.list_(pa.int64())),
        ("latest", latest, pa.int64()), ("max_tf", max_tf, pa.int32()), ("min_len", min_len, pa.int32()), ("n", n, pa.int32()),
        ("chunk_ids", ids if ids is not None else [None] * rows, pa.list_(pa.string())), ("total", total if total is not None else [None] * rows, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for _, v, t in columns], names=[c for c, _, _ in columns])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of rows that are sorted by month, domain and chunk."""
    key, waiting, size = None, [], 0

    def flush():
        rows = pa.Table.from_batches(waiting).combine_chunks()
        time = rows["updated_at"].combine_chunks().cast(pa.timestamp("us")).cast(pa.int64())
        yield from _segment(*key, rows["chunk_id"].to_pylist(), pc.fill_null(time, NO_TIME).to_numpy(), rows["terms"].combine_chunks())

    for rows in batches:
        keys = list(zip(rows.column("month").to_pylist(), rows.column("domain").to_pylist(), strict=True))
        start = 0
        for at in range(len(keys) + 1):
            change = at == len(keys) or keys[at] != key
            full = size + at - start == SEGMENT
            if change or full:
                if at > start:
                    waiting.append(rows.slice(start, at - start))
                    size += at - start
                start = at
                if waiting and (full or (at < len(keys) and keys[at] != key)):
                    yield from flush()
                    waiting, size = [], 0
                if at < len(keys):
                    key = keys[at]
    if waiting:
        yield from flush()


def append(chunks: DataFrame, folder: str) -> None:
    """Index ``chunks(chunk_id, domain, updated_at, terms)`` and add them to the index below ``folder``.

    A month that holds very many chunks is split over tasks by adaptive execution.
    """
    rows = chunks.select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("domain").cast("string").alias("domain"),
        F.col("updated_at").cast("timestamp").alias("updated_at"),
        F.date_format("updated_at", "yyyy-MM").alias("month"),
        "terms",
    )
    dealt = rows.hint("rebalance", F.col("month"), F.col("domain")).sortWithinPartitions("month", "domain", "chunk_id")
    made = settle(dealt.mapInArrow(_numbered, BLOCKS), "blocks")
    postings = made.where("term IS NOT NULL").drop("chunk_ids", "total").hint("rebalance", F.col("month"))
    (
        postings.sortWithinPartitions("month", "term").write.mode("append").option("parquet.block.size", 8 << 20)
        .option("parquet.bloom.filter.enabled#term", "true").partitionBy("month").parquet(f"{folder}/postings")
    )
    segments = made.where("term IS NULL").select("month", "segment", "chunk_ids", "n", "total").hint("rebalance", F.col("month"))
    segments.write.mode("append").partitionBy("month").parquet(f"{folder}/segments")


# searching --------------------------------------------------------------------------------------------


def _table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    fields = [f.strip() for f in BLOCKS.split(", ") if f.strip().split()[0] in columns.split()]
    return spark.read.schema(", ".join(fields)).parquet(f"{folder}/{name}")


class _Top:
    """The best k scores of many queries, with everything that ties with the last of them."""

    def __init__(self, queries: int, k: int):
        self.k, self.cut = k, np.zeros(queries)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, 2 * queries * k + (1 << 16)

    def add(self, query: np.ndarray, score: np.ndarray, segment: int, doc: np.ndarray) -> None:
        self.parts.append((query, score, np.full(len(query), segment), doc))
        self.size += len(query)
        if self.size > self.limit:
            self.prune()
            self.limit = max(self.limit, 2 * self.size)

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, np.int64) for _ in range(4))
        query, score, segment, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, query))
        sorted_query = query[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
        last = order[place == self.k - 1]
        self.cut[query[last]] = score[last]
        kept = score >= self.cut[query]
        self.parts = [(query[kept], score[kept], segment[kept], doc[kept])]
        self.size = int(kept.sum())
        return self.parts[0]


class _Asked:
    """A batch of queries: terms and weights, filters."""

    def __init__(self, rows: pd.DataFrame, terms: pd.DataFrame, average: float):
        self.ids = rows["query_id"].to_numpy(dtype=object)
        self.domains = rows["domain"].to_numpy(dtype=object)
        cutoffs = pd.to_datetime(rows["cutoff"]).to_numpy().astype("datetime64[us]")
        self.cutoffs = np.where(np.isnat(cutoffs), NO_TIME, cutoffs.astype(np.int64))
        self.average = average
        place = {q: i for i, q in enumerate(self.ids)}
        terms = terms.sort_values("term")
        self.vocabulary, first = np.unique(terms["term"].to_numpy(dtype=str), return_index=True)
        self.idf = terms["idf"].to_numpy()[first] if len(terms) else np.empty(0)
        self.query = terms["query_id"].map(place).to_numpy(dtype=np.int64)
        self.first = np.append(first, len(terms))

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.average))

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``term``, query) of every query of each term."""
        count = self.first[term + 1] - self.first[term]
        at = np.repeat(np.arange(len(term)), count)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.query[self.first[term][at] + offset]


def _score_segment(rows: pa.Table, asked: _Asked, top: _Top) -> int:
    """Add a segment's results; how many (query, segment) pairs were scored."""
    term = np.searchsorted(asked.vocabulary, rows["term"].to_numpy(zero_copy_only=False).astype(str))
    at, query = asked.spread(term)
    most = asked.idf[term] * asked.impact(rows["max_tf"].to_numpy().astype(float), rows["min_len"].to_numpy())
    bound = np.bincount(query, most[at], minlength=len(asked.ids))
    domain = rows["domain"][0].as_py()
    wanted = (bound > 0) & (bound + 10.0**-DIGITS >= top.cut) & ((asked.domains == "all") | (asked.domains == domain))
    if not wanted.any():
        return 0
    docs, tfs, lens, times = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("docs", "tfs", "lens", "times"))
    of_row = np.repeat(np.arange(len(term)), rows["n"].to_numpy())
    posting, query = asked.spread(term[of_row])
    seen = wanted[query] & (times[posting] >= asked.cutoffs[query])
    posting, query = posting[seen], query[seen]
    part = asked.idf[term[of_row]] * asked.impact(tfs.astype(float), lens)
    pair, back = np.unique(query * SEGMENT + docs[posting], return_inverse=True)
    score = np.round(np.bincount(back, part[posting], minlength=len(pair)), DIGITS)
    query = pair // SEGMENT
    good = (score > 0) & (score >= top.cut[query])
    top.add(query[good], score[good], rows["segment"][0].as_py(), pair[good] % SEGMENT)
    return int(wanted.sum())


def search(spark: SparkSession, folder: str, queries: DataFrame, text: str, k: int) -> DataFrame:
    """Top-k chunks per query by BM25 among those sharing a term: query_id, chunk_id, sparse, position, sparse_rank.

    ``queries``: query_id, query text, domain (``all`` for any), cutoff (nullable). Statistics are those of all indexed
    chunks; a query's filters only restrict what it may return. Equal scores go by chunk id.
    """
    segments = _table(spark, folder, "segments", "month segment chunk_ids n total")
    sums = segments.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    asked = settle(
        queries.select(F.col("query_id").cast("string").alias("query_id"), F.col(text).alias("_text"), "domain", F.col("cutoff").cast("timestamp").alias("cutoff")),
        "asked",
    )
    words = settle(query_terms(asked, "_text").select("query_id", "term"), "query-terms")
    postings = _table(spark, folder, "postings", "month segment domain term docs tfs lens times latest max_tf min_len n")
    batches = -(-asked.count() // BATCH_QUERIES) if sums.n else 0
    parts = []
    for number in range(batches):  # one plan: the scans of all batches run together
        mine = F.pmod(F.xxhash64("query_id"), F.lit(batches)) == number
        rows, terms = asked.where(mine).drop("_text").orderBy("query_id").toPandas(), words.where(mine).toPandas()
        if len(terms):
            parts.append(_batch(postings, rows, terms, sums, k))
    if not parts:
        return spark.createDataFrame([], "query_id string, chunk_id string, sparse double, position int, sparse_rank long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("sparse"))
    found = settle(reduce(DataFrame.unionByName, parts).withColumn("sparse_rank", F.rank().over(by_score).cast("long")).where(F.col("sparse_rank") <= k), "found")
    named = found.join(segments.select("segment", "chunk_ids"), "segment")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("sparse"), "chunk_id")
    return (
        named.select("query_id", F.get("chunk_ids", F.col("doc")).alias("chunk_id"), "sparse", "sparse_rank")
        .withColumn("position", F.row_number().over(best_first))
        .where(F.col("position") <= k)
        .select("query_id", "chunk_id", "sparse", "position", "sparse_rank")
    )


def reachable(postings: DataFrame, vocabulary: list[str], since) -> DataFrame:
    """The blocks of some terms that hold a chunk no query leaves out for its age (``since``: a time in microseconds)."""
    conf = postings.sparkSession.conf
    conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED_TERMS))
    kept = postings.where(F.expr(f"term IN ({sqltext.texts(vocabulary)})"))
    if since is None:
        return kept
    month = f"{pd.Timestamp(since, unit='us'):%Y-%m}"
    return kept.where((F.col("month") >= F.lit(month)) & (F.col("latest") >= F.lit(since)))


def _batch(postings: DataFrame, rows: pd.DataFrame, terms: pd.DataFrame, sums, k: int) -> DataFrame:
    vocabulary = sorted(set(terms["term"]))
    frequency = {r.term: r.df for r in reachable(postings, vocabulary, None).groupBy("term").agg(F.sum("n").alias("df")).collect()}
    terms = terms[terms["term"].isin(list(frequency))].copy()
    if terms.empty:
        return postings.sparkSession.createDataFrame([], FOUND)
    df = terms["term"].map(frequency).to_numpy(dtype=float)
    terms["idf"] = np.log1p((sums.n - df + 0.5) / (df + 0.5))
    packed = _Asked(rows, terms, sums.total / sums.n or 1.0)
    since = int(packed.cutoffs.min()) if (packed.cutoffs > NO_TIME).all() else None
    shared = postings.sparkSession.sparkContext.broadcast(packed)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, segment, waiting = shared.value, None, []
        top = _Top(len(asked.ids), k)
        for batch in batches:
            own = batch.column("segment").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])).tolist() if len(own) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if own[a] != segment and waiting:
                    _score_segment(pa.Table.from_batches(waiting), asked, top)
                    waiting = []
                segment = own[a]
                waiting.append(batch.slice(a, b - a))
        if waiting:
            _score_segment(pa.Table.from_batches(waiting), asked, top)
        query, score, segments, docs = top.prune()
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked.ids[query], pa.string()), pa.array(segments, pa.int64()), pa.array(docs, pa.int32()), pa.array(score, pa.float64())],
            names=["query_id", "segment", "doc", "sparse"],
        )

    blocks = reachable(postings, sorted(frequency), since).drop("month", "latest")
    return blocks.repartition("segment").sortWithinPartitions("segment").mapInArrow(each, FOUND)
