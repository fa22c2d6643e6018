"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint has 64 bits. It is cut into three segments (22, 21 and 21 bits), each padded to a word of
the perfect binary Golay code (23, 12, 7): every word lies within three bits of exactly one of the 4096
code words, whose 12-bit index is the word's decoding.

If two fingerprints differ in at most 4 bits, some two segments hold at most 2 of the differences, since
the third holds at least as many as either. Half-way between them, on these two segments, lies a pair of
words at most 1 bit from both. So a fingerprint's keys are, for each of the three pairs of segments, the
decoded indices (24 bits) of itself and of all its neighbours at 1 bit: at most 11 per pair, about 29 in
all, instead of the 2081 needed without the code. Linked fingerprints always share a key; those that
share one are verified by counting bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import batch, packed, scan
from veilgate.llm.components import connected_components
from veilgate.session import settle

#: Largest number of differing bits the keys can find.
RADIUS = 4
#: First bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75
#: Fingerprints of one bucket compared with each other; larger buckets are linked through mid-points.
BUCKET = 4096

_OFFSETS = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_TABLES: dict[str, np.ndarray] = {}


# fingerprints -----------------------------------------------------------------------------------


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: words between ASCII white space, A-Z lowered, hashed in shingles.

    A bit is 1 if it is set in over half of the XXH64 values. Repeated shingles count repeatedly, fewer
    words than a shingle are one shingle, a text without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _majority(xxhash.xxh64_digest(joined, seed))
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))[: len(words) - shingle + 1].tolist()
    ends = np.concatenate((blanks, [len(joined)]))[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return _majority(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)]))


def _majority(digests: bytes) -> int:
    parts = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((parts + _OFFSETS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    on = counts[::-1].ravel() * 2 > len(parts)  # digests are big-endian
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42
) -> DataFrame:
    """(``id_col``, ``bits long``) per row; null texts count as empty, other columns are ignored."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bits = np.array([simhash(t, shingle, seed) for t in rows.column(1).to_pylist()], dtype=np.uint64)
            yield batch({id_col: (rows.column(0), None), "bits": (bits.view(np.int64), pa.int64())})

    keyed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return scan(keyed, each, f"`{id_col}` {keyed.schema[0].dataType.simpleString()}, bits long")


# keys ---------------------------------------------------------------------------------------------


def code_words() -> np.ndarray:
    """The 4096 code words by index (systematic form: index, then 11 check bits)."""
    words = np.empty(4096, np.uint32)
    for index in range(4096):
        rest = index << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        words[index] = index << 11 | rest
    return words


def decoder() -> np.ndarray:
    """Index of the one code word within 3 bits of each of the 2^23 words."""
    if "decoder" not in _TABLES:
        words, table = code_words(), np.empty(1 << 23, np.uint16)
        index = np.arange(4096, dtype=np.uint16)
        for weight in range(4):
            for places in itertools.combinations(range(23), weight):
                table[words ^ np.uint32(sum(1 << p for p in places))] = index
        _TABLES["decoder"] = table
    return _TABLES["decoder"]


def golay_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every distinct key of each fingerprint (uint64)."""
    table = decoder()
    own, near = [], []
    for start, width in SEGMENTS:
        word = ((bits >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        own.append(table[word].astype(np.int32)[:, None])
        flips = np.uint32(1) << np.arange(width, dtype=np.uint32)
        near.append(table[word[:, None] ^ flips[None, :]].astype(np.int32))
    rows, keys = [], []
    for number, (s, t) in enumerate(itertools.combinations(range(3), 2)):
        both = np.concatenate(
            [own[s] << 12 | own[t], near[s] << 12 | own[t], own[s] << 12 | near[t]], axis=1
        ) | np.int32(number << 24)
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        rows.append(np.nonzero(first)[0])
        keys.append(both[first])
    return np.concatenate(rows), np.concatenate(keys)


def mid_points(bits: int) -> np.ndarray:
    """All words within 2 bits of a fingerprint, itself included: 2081."""
    if "masks" not in _TABLES:
        ones = [1 << i for i in range(64)]
        _TABLES["masks"] = np.array([0, *ones, *(a | b for a, b in itertools.combinations(ones, 2))], np.uint64)
    return _TABLES["masks"] ^ np.uint64(bits)


# links --------------------------------------------------------------------------------------------


def link_within(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(i, j) tying every fingerprint to the first of its component at this radius; nothing for single ones."""
    n = len(bits)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= radius
    label = np.full(n, -1)
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], edge = first, np.array([first])
        while len(edge):
            fresh = near[edge].any(axis=0) & (label < 0)
            label[fresh] = first
            edge = np.flatnonzero(fresh)
    return [(i, int(label[i])) for i in np.flatnonzero(label != np.arange(n))]


def keyed_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(key, fingerprints, whole) of runs of equal keys in sorted rows; a run over the limit comes in parts, not whole."""
    key, kept, open_run = None, [], False

    def flush():
        if kept and (open_run or len(kept) > 1):
            yield key, np.array(kept, np.int64).view(np.uint64), not open_run

    for rows in batches:
        keys = rows.column(0).to_numpy(zero_copy_only=False)
        bits = rows.column(1).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist() if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[a] != key:
                yield from flush()
                key, kept, open_run = keys[a], [], False
            kept.extend(bits[a:b].tolist())
            if len(kept) > limit:
                open_run = True
                yield from flush()
                kept = []
    yield from flush()


def links(distinct_bits: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges whose components are those of the graph 'at most ``radius`` differing bits'.

    ``distinct_bits(bits long)``. A bucket of fingerprints with one key gives at most one edge per member,
    never all its pairs. A bucket over the limit is not compared in one task: its members go to their 2081
    mid-points instead; two fingerprints share a mid-point exactly if they differ in at most 4 bits, and no
    mid-point has more than 2081 members, so that way is exact whatever the size of the bucket.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the keys find at most {RADIUS} differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bits = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = golay_keys(bits)
            yield batch({"key": (key, pa.int32()), "bits": (bits[row].view(np.int64), pa.int64())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, bits, whole in keyed_groups(batches, bucket):
                signed = bits.view(np.int64)
                if whole:
                    pairs = link_within(bits, radius)
                    yield [int(signed[i]) for i, _ in pairs], [int(signed[j]) for _, j in pairs], [False] * len(pairs)
                else:
                    yield signed, signed, [True] * len(signed)

        return packed(parts(), {"u": pa.int64(), "v": pa.int64(), "hot": pa.bool_()})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for bits in rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                points = mid_points(int(bits))
                own = np.full(len(points), bits, np.uint64)
                yield batch({"key": (points.view(np.int64), pa.int64()), "bits": (own.view(np.int64), pa.int64())})

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for _, bits, _ in keyed_groups(batches, 1 << 12):
                signed = bits.view(np.int64).tolist()
                pairs = [(i, 0) for i in range(1, len(bits))] if radius == RADIUS else link_within(bits, radius)
                yield [signed[i] for i, _ in pairs], [signed[j] for _, j in pairs]

        return packed(parts(), {"u": pa.int64(), "v": pa.int64()})

    buckets = scan(distinct_bits.select("bits"), keyed, "key int, bits long")
    buckets = buckets.repartition("key").sortWithinPartitions("key", "bits")
    found = settle(scan(buckets, compare, "u long, v long, hot boolean").distinct(), "links")
    edges = found.where("NOT hot").select("u", "v")
    crowded = found.where("hot").selectExpr("u AS bits").distinct()
    if not crowded.isEmpty():
        points = scan(crowded, spread, "key long, bits long").repartition("key").sortWithinPartitions("key", "bits")
        edges = edges.unionByName(scan(points, star, "u long, v long").distinct())
    return edges


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = RADIUS,
    seed: int = 42,
    bucket: int = BUCKET,
) -> DataFrame:
    """(``id_col``, ``bits long``, ``component_id``) per input row.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits. Equal
    fingerprints (all empty texts, for one) belong together without being compared. Repeated rows come back
    repeated; null ids are never chosen while another id is there. Links and components stay tables:
    fingerprints meet per key, edges per node, and a hot group is one fingerprint after the first count.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    groups = settle(marked.groupBy("bits").agg(F.min(id_col).alias("least")), "simhash-groups")
    roots = connected_components(links(groups.select("bits"), radius, bucket))
    rooted = settle(
        groups.join(roots, F.col("bits") == F.col("node"), "left").select(
            "bits", "least", F.coalesce("root", "bits").alias("root")
        ),
        "roots",
    )
    smallest = settle(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    by_bits = rooted.join(smallest, "root").select("bits", "component_id")
    return marked.join(by_bits, "bits").select(id_col, "bits", "component_id")


def document_links(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = RADIUS,
    seed: int = 42,
    bucket: int = BUCKET,
) -> DataFrame:
    """(u, v) edges between ids whose components are those of ``near_duplicates``, to be joined with other links.

    Null ids are left out; the ids are whole numbers.
    """
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    marked = settle(fingerprints(known, id_col, text_col, shingle, seed), "simhash")
    groups = settle(marked.groupBy("bits").agg(F.min(id_col).alias("least")), "simhash-groups")
    found = settle(links(groups.select("bits"), radius, bucket), "simhash-links")
    between = (
        found.join(groups.selectExpr("bits AS u", "least AS first"), "u")
        .join(groups.selectExpr("bits AS v", "least AS second"), "v")
        .select(F.col("first").alias("u"), F.col("second").alias("v"))
    )
    same = marked.join(groups, "bits").select(F.col(id_col).alias("u"), F.col("least").alias("v"))
    return between.unionByName(same).where("u <> v")


def hex_fingerprint(bits: str = "bits") -> Column:
    """16 lowercase hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(F.col(bits))), 16, "0")
