"""Near-duplicates by MinHash bands, screened by odd sketches and decided on whole shingle sets.

A text's MinHash samples (number and value) are folded into a parity bitmap: each sample flips one bit. The bits in
which two bitmaps differ estimate how many samples differ, most precisely where texts are much alike, at a
few machine words a text. Texts agreeing in one of BANDS bands of samples are candidates; bitmaps only
rule out those five standard errors beyond the limit. What remains hangs together in loose groups, in which links are
decided on all shingles. Equal sets are one class from the start, so exact copies cost nothing further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.llm.common import batch, scan
from veilgate.llm.components import connected_components
from veilgate.llm.metric_groups import BUCKET, BitStrings, HashSets, connect
from veilgate.session import settle

#: Bands and samples per band: at similarity 0.8 two texts share none in 3 cases of a million.
BANDS, ROWS = 24, 4
#: MinHash samples folded into a bitmap (the bands' and more), and its bits.
SAMPLES, BITS = 192, 512
#: So far below the limit an estimate may lie before a pair is ruled out: five standard errors at 0.8 (0.033 each).
SLACK = 0.165
#: Shingles compared in one task; a shingle takes about six characters.
SHINGLES = 4 << 20
#: Texts of loose groups whose keys are broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SEEDS = np.random.default_rng(12).integers(0, 1 << 64, (2, SAMPLES, 1), np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles hashed at a time.
_PART = 1024


def shingle_set(text: str | None, shingle: int = 4) -> np.ndarray:
    """Sorted distinct hashes of the shingles: words between ASCII white space, A-Z lowered. Fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))[: max(1, len(words) - shingle + 1)].tolist()
    ends = np.concatenate((blanks, [len(joined)]))[min(shingle, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_digest
    found = b"".join([of(joined[a:b], 12) for a, b in zip(starts, ends, strict=True)])
    return np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minimum hashes of a set that is not empty."""
    least = np.full(SAMPLES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _PART):
        part = (hashes[None, at : at + _PART] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        np.minimum(least, part.min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """The parity bitmap of some samples: sample number and value choose the bit that is flipped."""
    mixed = ((least >> np.uint64(7)) ^ least ^ _SEEDS[0, :, 0]) * _SPREAD
    flips = np.bincount((mixed >> np.uint64(40)) % np.uint64(BITS), minlength=BITS)
    return np.packbits(flips & 1 == 1).tobytes()


def estimate(differing_bits: np.ndarray | int) -> np.ndarray:
    """Similarity by the number of bits in which two bitmaps differ."""
    share = np.minimum(2 * np.asarray(differing_bits) / BITS, 1 - 1 / BITS)
    return 1 + BITS * np.log(1 - share) / (4 * SAMPLES)


def bits_at(similarity: float) -> int:
    """Differing bits expected at a similarity: the inverse of ``estimate``."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))]


def _profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """One row per text: row (a number of its own), id, two hashes of the text, its set's digest and size, bands, bitmap."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 40
        for rows in batches:
            sets = [shingle_set(t, shingle) for t in rows.column(3).to_pylist()]
            least = [samples(x) if len(x) else None for x in sets]
            yield batch(
                {
                    "row": (np.arange(seen, seen + len(sets)), pa.int64()),
                    "id": (rows.column(0), None),
                    "h1": (rows.column(1), None),
                    "h2": (rows.column(2), None),
                    "digest": ([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                    "size": ([len(x) for x in sets], pa.int64()),
                    "keys": ([band_keys(x) if x is not None else [] for x in least], pa.list_(pa.int64())),
                    "sketch": ([odd_sketch(x) if x is not None else b"" for x in least], pa.binary()),
                }
            )
            seen += len(sets)

    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), *_text_key(text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("h1", "h2")]
    rest = T.StructType.fromDDL("digest binary, size long, keys array<long>, sketch binary")
    return scan(keyed, each, T.StructType([T.StructField("row", T.LongType()), keyed.schema[0], *longs, *rest]))


def _text_key(text_col: str) -> list:
    text = F.col(f"`{text_col}`").cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(12), text).alias("h2")]


def _band_groups(classes: DataFrame) -> DataFrame:
    """(group, id, size): classes that share a band; bands with the same members are one group."""
    keys = settle(classes.select("node", F.explode("keys").alias("key")), "bands")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), *marks).where("n > 1")
    once = settle(shared.groupBy("n", "mark1", "mark2").agg(F.min("key").alias("key")).select("key"), "groups")
    return settle(keys.join(once, "key").select(F.col("key").alias("group"), F.col("node").alias("id"), F.lit(0).cast("long").alias("size")), "band-groups")


def class_links(
    docs: DataFrame,
    classes: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    similarity: float = 0.8,
    bucket: int = BUCKET,
) -> DataFrame:
    """(u, v) edges between classes (their ``node``) whose sets overlap by ``similarity`` or more, enough to connect every group."""
    near = connect(
        _band_groups(classes),
        lambda rows: rows.join(classes.select(F.col("node").alias("id"), F.col("sketch").alias("value")), "id"),
        bytes,
        BitStrings,
        bits_at(similarity - SLACK),
        bucket,
    )
    loose = connected_components(settle(near, "screened"))
    members = settle(loose.join(classes.select("node", "size", "key"), "node").selectExpr("root AS group", "node AS id", "size", "key"), "loose")
    wanted = members.selectExpr("id AS node", "key.id AS kid", "key.h1 AS h1", "key.h2 AS h2")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(f"`{id_col}`").alias("own"), *_text_key(text_col), F.col(f"`{text_col}`").cast("string").alias("value"))
    texts = texts.join(wanted, (texts.h1 == wanted.h1) & (texts.h2 == wanted.h2) & texts.own.eqNullSafe(wanted.kid)).select("node", "value")
    if not classes.where("repeats > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # rows equal in id and text
    texts = settle(texts, "loose-texts")
    return connect(
        members.select("group", "id", "size"),
        lambda rows: rows.join(texts.withColumnRenamed("node", "id"), "id"),
        lambda text: shingle_set(text, shingle),
        HashSets,
        round(1 - similarity, 9),
        bucket,
        SHINGLES,
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    similarity: float = 0.8,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (the smallest id reachable over links), kept.

    Texts are linked if their sets of distinct shingles overlap by ``similarity`` or more; null texts and those without
    words have an empty set and belong to nothing but themselves. A row is kept if its id is the component's; rows
    with null ids take part, name no component where another id is there, and are kept where none is. Repeated rows
    come back repeatedly, other columns are ignored, an empty table gives an empty one.
    """
    rows = settle(_profiles(docs, id_col, text_col, shingle), "profiles")
    some = rows.where("size > 0")
    key = F.struct("id", "h1", "h2")
    repeated = some.groupBy(key.alias("key")).agg(F.count("*").alias("repeats")).where("repeats > 1")
    firsts = [F.first(c).alias(c) for c in ("size", "keys", "sketch")]
    classes = some.groupBy("digest").agg(F.min("row").alias("node"), F.min_by(key, "row").alias("key"), F.min("id").alias("least"), *firsts)
    repeated = repeated.select("key.*", "repeats").selectExpr("id AS rid", "h1 AS r1", "h2 AS r2", "repeats")
    same = F.col("key.id").eqNullSafe(F.col("rid")) & (F.col("key.h1") == F.col("r1")) & (F.col("key.h2") == F.col("r2"))
    classes = settle(classes.join(repeated, same, "left").drop("rid", "r1", "r2"), "classes")
    roots = connected_components(class_links(docs, classes, id_col, text_col, shingle, similarity, bucket))
    rooted = settle(classes.select("digest", "node", "least").join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_class = settle(rooted.join(smallest, "root").select("digest", "component"), "components")
    linked = rows.select("id", "size", F.when(F.col("size") > 0, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id"))
    return linked.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
