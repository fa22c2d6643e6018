"""Approximate vector search: an inverted file with product quantisation, stored and partitioned by list.

Vectors are unit vectors, likeness is their cosine. Each is coded as its list (nearest centroids) and one byte per
subspace for the rest, so a search reads a few bytes per vector, of the lists nearest to its queries only, and ranks
them by table lookup. The best ``depth`` per query are ranked again by their stored vectors.

Centroids and code books are fitted on a bounded sample; every vector is indexed. How many lists a query probes is
measured when the index is built: the fewest that reach the wanted recall on queries from the sample. New vectors are
appended under the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgate.session import settle

#: Vectors the model is fitted on at most, and queries among them that measure the recall.
SAMPLE_ROWS, TRIAL_QUERIES = 20_000, 200
#: Queries answered by one scan of their lists.
BATCH_QUERIES = 1024
#: Likenesses that a task holds at a time.
CELLS = 1_000_000
#: Bytes of a code book entry number.
CODES = 256
DIGITS = 6

FIELDS = "list int, home int, chunk_id string, copy int, code binary, embedding array<float>, domain string, updated_at timestamp"
CANDIDATES = "query_id string, chunk_id string, home int, likeness double"


@dataclass
class Model:
    """Centroids (lists x width), code books (subspaces x entries x part), lists per vector and per query, depth."""

    centroids: np.ndarray
    books: np.ndarray
    copies: int
    probes: int
    depth: int

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors, filled with zeros to the width of the subspaces."""
        unit = _unit(vectors)
        return np.pad(unit, ((0, 0), (0, self.width - unit.shape[1])))

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first; a slice of the vectors at a time, as there are many lists."""
        n, step = min(n, len(self.centroids)), max(1, CELLS // len(self.centroids))
        found = np.empty((len(unit), n), np.int64)
        for start in range(0, len(unit), step):
            likeness = unit[start : start + step] @ self.centroids.T
            some = np.argpartition(-likeness, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(likeness, some, 1), axis=1, kind="stable")
            found[start : start + step] = np.take_along_axis(some, order, 1)
        return found

    def codes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """One byte per subspace for what the centroid of ``lists`` leaves of each vector."""
        rest = (unit - self.centroids[lists]).reshape(len(unit), self.books.shape[0], -1)
        out = np.empty(rest.shape[:2], np.uint8)
        for s, book in enumerate(self.books):
            out[:, s] = (rest[:, s] @ book.T * 2 - (book**2).sum(axis=1)).argmax(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Likeness of each query's parts with each entry of the code books: queries x subspaces x entries."""
        parts = queries.reshape(len(queries), self.books.shape[0], -1)
        return np.einsum("qsp,sep->qse", parts, self.books, optimize=True).astype(np.float32)

    def likeness(self, queries: np.ndarray, tables: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosine of queries with the coded vectors of one list."""
        found = np.repeat((queries @ self.centroids[which])[:, None], len(codes), axis=1)
        for s in range(codes.shape[1]):
            found += tables[:, s][:, codes[:, s]]
        return found

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [("centroid", i, v.tolist()) for i, v in enumerate(self.centroids)]
        rows += [("book", i, v.ravel().tolist()) for i, v in enumerate(self.books)]
        rows += [("setting", 0, [float(self.copies), float(self.probes), float(self.depth)])]
        spark.createDataFrame(rows, "kind string, number int, value array<double>").coalesce(1).write.parquet(f"{folder}/model")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Model:
        rows = sorted(spark.read.parquet(f"{folder}/model").collect(), key=lambda r: (r.kind, r.number))
        of = {kind: [r.value for r in rows if r.kind == kind] for kind in ("centroid", "book", "setting")}
        centroids, books = np.array(of["centroid"]), np.array(of["book"])
        part = centroids.shape[1] // len(books)
        return Model(centroids, books.reshape(len(books), -1, part), *(int(x) for x in of["setting"][0]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _means(points: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations; a centre that loses all its points takes over one at random."""
    centres = points[rng.choice(len(points), min(n, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = (points @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], points[rng.choice(len(points), len(centres))])
    return centres


def fit(
    vectors: DataFrame, k: int = 10, lists: int | None = None, subspaces: int = 16, copies: int = 2, recall: float = 0.95,
    sample_rows: int = SAMPLE_ROWS, seed: int = 7,
) -> Model | None:
    """A model of ``vectors(chunk_id, embedding)`` from the ``sample_rows`` of them with the least hash of their id.

    ``lists`` defaults to the root of their number, at most an eighth of the sample. None if there is no vector.
    """
    known = vectors.where(F.col("embedding").isNotNull())
    total = known.count()
    if not total:
        return None
    rows = known.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample_rows).toArrow()
    sample = _unit(np.stack(rows["embedding"].to_numpy(zero_copy_only=False)).astype(float))
    part = -(-sample.shape[1] // min(subspaces, sample.shape[1]))
    subspaces = -(-sample.shape[1] // part)
    sample = np.pad(sample, ((0, 0), (0, subspaces * part - sample.shape[1])))
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists or round(total**0.5), -(-len(sample) // 8)))
    centroids = _means(sample, lists, rng)
    rest = sample - centroids[(sample @ centroids.T * 2 - (centroids**2).sum(axis=1)).argmax(axis=1)]
    books = np.stack([_means(rest[:, s * part : (s + 1) * part], CODES, rng) for s in range(subspaces)])
    model = Model(centroids, books, min(copies, len(centroids)), len(centroids), 20 * k)
    model.probes = _probes_for(model, sample, total, k, recall, rng)
    return model


def _probes_for(model: Model, sample: np.ndarray, total: int, k: int, wanted: float, rng: np.random.Generator) -> int:
    """The fewest lists that reach the recall on the sample; the depth is scaled to its share of the vectors."""
    trial = sample[rng.choice(len(sample), min(TRIAL_QUERIES, len(sample)), replace=False)]
    exact = np.argsort(-(trial @ sample.T), axis=1, kind="stable")[:, :k]
    homes = model.nearest(sample, model.copies)
    rough = np.full((len(trial), len(sample)), -np.inf)
    place = np.full((len(trial), len(sample)), len(model.centroids))  # the first of the query's lists that holds a vector
    order = np.argsort(model.nearest(trial, len(model.centroids)), axis=1)
    tables = model.tables(trial)
    for which in range(len(model.centroids)):
        own = np.flatnonzero((homes == which).any(axis=1))
        if len(own):
            found = model.likeness(trial, tables, which, model.codes(sample[own], np.full(len(own), which)))
            rough[:, own] = np.maximum(rough[:, own], found)
            place[:, own] = np.minimum(place[:, own], order[:, which][:, None])
    depth = max(k, min(len(sample), round(model.depth * len(sample) / total)))
    low, high = 1, len(model.centroids)
    while low < high:
        probes = (low + high) // 2
        seen = np.where(place < probes, rough, -np.inf)
        cut = -np.partition(-seen, depth - 1, axis=1)[:, depth - 1]
        hit = np.take_along_axis((seen >= cut[:, None]) & (seen > -np.inf), exact, 1)
        low, high = (low, probes) if hit.mean() >= wanted else (probes + 1, high)
    return low


# the stored index -------------------------------------------------------------------------------------


def append(vectors: DataFrame, folder: str, model: Model) -> None:
    """Code ``vectors(chunk_id, embedding, domain, updated_at)`` and add them to the lists; null vectors have no entry.

    Rows go to their list's folder; adaptive execution splits lists that attract very many and joins small ones.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            raw = np.stack(rows.column(1).to_numpy(zero_copy_only=False)).astype(float) if rows.num_rows else np.empty((0, 1))
            if not len(raw):
                continue
            unit = model.padded(raw)
            lists = model.nearest(unit, model.copies)
            for copy in range(lists.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lists[:, copy], pa.int32()),
                        pa.array(lists[:, 0], pa.int32()),
                        rows.column(0),
                        pa.array(np.full(len(unit), copy), pa.int32()),
                        pa.array([c.tobytes() for c in model.codes(unit, lists[:, copy])], pa.binary()),
                        rows.column(1) if copy == 0 else pa.nulls(len(unit), rows.column(1).type),
                        rows.column(2),
                        rows.column(3),
                    ],
                    names=[f.split()[0] for f in FIELDS.split(", ")],
                )

    given = vectors.where(F.col("embedding").isNotNull()).select(
        F.col("chunk_id").cast("string"), F.col("embedding").cast("array<float>"), F.col("domain").cast("string"), F.col("updated_at").cast("timestamp")
    )
    coded = given.mapInArrow(each, FIELDS).hint("rebalance", F.col("list"))
    coded.write.mode("append").partitionBy("list").parquet(f"{folder}/lists")


def build(vectors: DataFrame, folder: str, **settings) -> Model | None:
    """Fit a model (see ``fit``), store it below ``folder`` and index all vectors; None if there are none."""
    model = fit(vectors, **settings)
    if model:
        model.save(vectors.sparkSession, folder)
        append(vectors, folder, model)
    return model


class _Best:
    """The best ``depth`` rows of many queries, pruned together."""

    def __init__(self, queries: int, depth: int):
        self.depth, self.cut = depth, np.full(queries, -np.inf)
        self.query, self.score, self.row, self.home = [], [], [], []
        self.size, self.limit = 0, 2 * queries * depth + (1 << 16)

    def add(self, queries: np.ndarray, scores: np.ndarray, rows: np.ndarray, homes: np.ndarray) -> None:
        q, r = np.nonzero(scores > self.cut[queries][:, None])
        self.query.append(queries[q])
        self.score.append(scores[q, r])
        self.row.append(rows[r])
        self.home.append(homes[r])
        self.size += len(q)
        if self.size > self.limit:
            self.prune()

    def prune(self) -> None:
        if not self.query:
            return
        query, score, row, home = (np.concatenate(x) for x in (self.query, self.score, self.row, self.home))
        order = np.lexsort((-score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        kept = order[place < self.depth]
        self.query, self.score, self.row, self.home = ([x[kept]] for x in (query, score, row, home))
        self.size = len(kept)
        least = np.full(len(self.cut), np.inf)
        np.minimum.at(least, query[kept], score[kept])
        full = np.bincount(query[kept], minlength=len(self.cut)) == self.depth
        self.cut[full] = least[full]


def candidates(index: DataFrame, asked: pd.DataFrame, model: Model) -> DataFrame:
    """(query_id, chunk_id, home, likeness): per task the best ``depth`` of each query by their codes."""
    vectors = model.padded(np.stack(asked["query_vector"].to_numpy()).astype(float))
    probed = model.nearest(vectors, model.probes)
    wanted = sorted(set(probed.ravel().tolist()))
    of_list = {which: np.flatnonzero((probed == which).any(axis=1)) for which in wanted}
    domains, cutoffs = asked["domain"].to_numpy(dtype=object), pd.to_datetime(asked["cutoff"]).to_numpy()
    names = asked["query_id"].to_numpy(dtype=object)
    shared = index.sparkSession.sparkContext.broadcast((vectors, of_list, domains, cutoffs, names, model))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _best_by_codes(batches, *shared.value)

    rows = index.where(F.col("list").isin(*wanted)).select("list", "home", "chunk_id", "code", "domain", "updated_at")
    return rows.mapInArrow(each, CANDIDATES)


def _best_by_codes(
    batches: Iterator[pa.RecordBatch], vectors: np.ndarray, of_list: dict, domains: np.ndarray, cutoffs: np.ndarray, names: np.ndarray, model: Model
) -> Iterator[pa.RecordBatch]:
    """The best ``depth`` rows of each query; rows of a list meet its queries a slice at a time, however long the list."""
    best, tables = _Best(len(names), model.depth), model.tables(vectors)
    for rows in batches:
        lists = rows.column(0).to_numpy()
        home, chunk = rows.column(1).to_numpy(), np.array(rows.column(2).to_pylist(), dtype=object)
        codes = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        domain = rows.column(4).to_numpy(zero_copy_only=False)
        updated = pd.to_datetime(rows.column(5).to_pandas()).dt.tz_localize(None).to_numpy()
        for which in np.unique(lists).tolist():
            every, queries = np.flatnonzero(lists == which), of_list.get(which, [])
            if not len(queries):
                continue
            # queries that share a filter are masked together
            groups = pd.Series(range(len(queries))).groupby([domains[queries], pd.Series(cutoffs[queries]).astype("int64").to_numpy()], dropna=False)
            members = [(wanted, at.to_numpy()) for (wanted, _), at in groups]
            asked, looked_up, step = vectors[queries], tables[queries], max(1, CELLS // len(queries))
            for start in range(0, len(every), step):
                mine = every[start : start + step]
                scores = model.likeness(asked, looked_up, which, codes[mine])
                for wanted, at in members:
                    seen = np.ones(len(mine), bool) if wanted == "all" else domain[mine] == wanted
                    since = cutoffs[queries][at[0]]
                    if not np.isnat(since):
                        seen = seen & (updated[mine] >= since)
                    best.add(queries[at], scores[at][:, seen], chunk[mine][seen], home[mine][seen])
    best.prune()
    for query, row, home, score in zip(best.query, best.row, best.home, best.score, strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[query], pa.string()), pa.array(row, pa.string()), pa.array(home, pa.int32()), pa.array(score.astype(float))],
            names=["query_id", "chunk_id", "home", "likeness"],
        )


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """Approximate top k per query, as ``dense_top`` gives the exact ones: query_id, chunk_id, dense, dense_rank, position.

    ``queries``: query_id, query_vector, domain (``all`` for any), cutoff (nullable). Only the folders of probed lists are
    read. The stored vectors of the best candidates decide their order; ties go by chunk id.
    """
    model = Model.load(spark, folder)
    model.probes = min(probes or model.probes, len(model.centroids))
    model.depth = max(model.depth, k)
    index = spark.read.schema(FIELDS).parquet(f"{folder}/lists")
    asked = settle(
        queries.where(F.col("query_vector").isNotNull()).select(
            F.col("query_id").cast("string").alias("query_id"), "query_vector", "domain", F.col("cutoff").cast("timestamp").alias("cutoff")
        ),
        "asked",
    )
    batches = -(-asked.count() // BATCH_QUERIES)
    found = None
    for number in range(batches):  # one plan: the scans of all batches run together
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == number).orderBy("query_id").toPandas()
        if len(rows):
            part = candidates(index, rows, model)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id string, chunk_id string, dense double, dense_rank long, position int")
    once = found.groupBy("query_id", "chunk_id", "home").agg(F.max("likeness").alias("likeness"))
    by_code = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "chunk_id")
    near = settle(once.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= model.depth).drop("n", "likeness"), "candidates")
    homes = [r.home for r in near.select("home").distinct().collect()]
    stored = index.where(F.col("list").isin(*homes) & (F.col("copy") == 0)).select(F.col("list").alias("home"), "chunk_id", "embedding")
    pairs = near.join(stored, ["home", "chunk_id"]).join(asked.select("query_id", "query_vector"), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                a, b = (_unit(np.stack(rows.column(c).to_numpy(zero_copy_only=False)).astype(float)) for c in (2, 3))
                dense = np.round(np.einsum("ij,ij->i", a, b), DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dense)], names=["query_id", "chunk_id", "dense"])

    scored = pairs.select("query_id", "chunk_id", "query_vector", "embedding").mapInArrow(exact, "query_id string, chunk_id string, dense double")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("dense"), "chunk_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("dense"))
    return (
        scored.withColumn("position", F.row_number().over(best_first))
        .where(F.col("position") <= k)
        .withColumn("dense_rank", F.rank().over(by_score).cast("long"))
        .select("query_id", "chunk_id", "dense", "dense_rank", "position")
    )
