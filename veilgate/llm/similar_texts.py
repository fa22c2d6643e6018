"""Near copies by word shingles (five words, similarity 0.8), on top of Golay-keyed SimHash.

The contract's fingerprint counts every shingle, and one changed word in fifty already moves more than its 4
bits. Here candidates come from the five-word shingles themselves: texts that agree in all minimum hashes of one
of BANDS bands. How often two texts share a band depends on their similarity alone, not on the kind of edit: at
0.8 a pair has none in 3 cases of a million.

Equal texts (words, lower case) are one class first. Classes that share a band travel as ids; sketches are joined
to the few that have company. A sketch only rules out pairs far below the limit: what remains hangs together in
loose groups, whose texts move once and are compared by all their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.llm import golay_dedup as golay
from veilgate.llm.common import batch, packed, scan
from veilgate.llm.components import connected_components
from veilgate.session import settle

#: Bands per text and minimum hashes per band: 1 - (1 - s^4)^24 of the pairs of similarity s share a band.
BANDS, ROWS = 24, 4
#: Minimum hashes per sketch, each cut to a byte: the standard error of a similarity is at most 0.03.
BINS = 256
#: So far below the limit an estimate may lie before a pair is ruled out: five standard errors.
SLACK = 0.15
#: Shingles of a loose group compared in one task.
SHINGLES = 4 << 20
#: Texts of loose groups whose ids are broadcast; the ids of more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
#: Shingles hashed at a time.
_PART = 2048


def shingles_of(text: str | None, shingle: int = 5) -> tuple[bytes, np.ndarray]:
    """(words joined by blanks, sorted distinct hashes of the shingles); a shorter text is one shingle."""
    words = (text or "").lower().encode().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.empty(0, np.uint64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], blanks + 1))[:n].tolist()
    ends = np.concatenate((blanks, [len(joined)]))[min(shingle, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_digest
    found = b"".join([of(joined[a:b], 7) for a, b in zip(starts, ends, strict=True)])
    return joined, np.unique(np.frombuffer(found, ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band of minimum hashes; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), _PART):
        part = (hashes[None, at : at + _PART] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))
        np.minimum(least, part.min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def profile(text: str | None, shingle: int = 5) -> tuple[bytes, list[int], bytes]:
    """(digest of the words, band keys, sketch: minimum hashes of the shingles).

    Sketch: the hashes fall into BINS bins by their high bits, the least of each bin is kept by one of
    its bytes, the byte 0 marks an empty bin.
    """
    joined, hashes = shingles_of(text, shingle)
    least = np.zeros(BINS, np.uint8)
    bin_of = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = bin_of[1:] != bin_of[:-1]
    least[bin_of[first]] = (hashes[first] % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return xxhash.xxh3_128_digest(joined), band_keys(hashes), least.tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated overlap of each row of ``a`` (n, BINS) with the rows of ``b``: (n, len(b)). Two empty texts are alike."""
    out = np.empty((len(a), len(b)))
    filled = b != 0
    for k, row in enumerate(a):
        same = ((b == row) & filled).sum(axis=1)
        either = (filled | (row != 0)).sum(axis=1)
        out[k] = np.where(either, same / np.maximum(either, 1), 1.0)
    return out


def _forest(ids: list[int], sketches: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what is alike in one group, one per member at most."""
    n = len(ids)
    label = np.full(n, -1)
    edges = []
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start], front = start, [start]
        while front:
            open_ones = np.flatnonzero(label < 0)
            if not len(open_ones):
                break
            near = likeness(sketches[front], sketches[open_ones]) >= similarity
            hit = near.any(axis=0)
            via = near.argmax(axis=0)
            edges += [(ids[open_ones[k]], ids[front[via[k]]]) for k in np.flatnonzero(hit)]
            label[open_ones[hit]] = start
            front = open_ones[hit].tolist()
    return edges


def exact_forest(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the sets whose overlap is ``similarity`` or more, one per member at most; no set is empty."""
    size = np.array([len(x) for x in sets], np.int64)
    entries = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = np.split(entries, np.cumsum(size)[:-1])
    mark = np.zeros(int(entries.max()) + 1, bool)
    waiting = np.arange(len(ids))  # not tied yet; ``flat`` and ``at`` are their entries and where each begins
    flat, at = entries, np.cumsum(size) - size
    edges = []
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        flat, at = flat[size[front[0]] :], at[1:] - size[front[0]]
        while front and len(waiting):
            one = front.pop()
            mark[own[one]] = True
            common = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[own[one]] = False
            hit = common >= similarity * (size[waiting] + size[one] - common) - 1e-9
            if hit.any():
                edges += [(ids[k], ids[one]) for k in waiting[hit]]
                front += waiting[hit].tolist()
                flat = flat[np.repeat(~hit, size[waiting])]
                waiting = waiting[~hit]
                at = np.cumsum(size[waiting]) - size[waiting]
    return edges


def similar_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket: int = golay.BUCKET
) -> tuple[DataFrame, DataFrame]:
    """(rows, links): ``rows(id, rep)`` ties every row to the least id of its equal texts, ``links(u, v)`` ties such
    ids whose texts are alike, enough of them to connect every group.

    Ids are whole numbers; null ids are ignored, texts may be null. A group of more than ``bucket`` classes is dealt as
    tiles, every block of it against every other block, so no pair goes uncompared and the memory stays bounded.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            found = [profile(t, shingle) for t in texts]
            yield batch(
                {
                    "id": (rows.column(0), None),
                    "text": ([d for d, _, _ in found], pa.binary()),
                    "keys": ([k for _, k, _ in found], pa.list_(pa.int64())),
                    "sketch": ([s for _, _, s in found], pa.binary()),
                    "size": ([len(t or "") for t in texts], pa.int64()),
                }
            )

    named = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = settle(scan(named, read, "id long, text binary, keys array<long>, sketch binary, size long"), "profiles")
    firsts = [F.first(c).alias(c) for c in ("keys", "sketch", "size")]
    classes = settle(rows.groupBy("text").agg(F.min("id").alias("rep"), *firsts), "classes")
    tied = rows.select("id", "text").join(classes.select("text", "rep"), "text").select("id", "rep")
    keys = settle(classes.select("rep", F.explode("keys").alias("key")), "bands")
    groups = _groups(keys).withColumn("blocks", F.ceil(F.col("n") / bucket))
    sketched = groups.join(classes.select("rep", "sketch"), "rep")
    dealt = _tiles(sketched, "group", "rep")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for ids, sketches in _runs(batches):
                edges = _forest(ids, np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, BINS), similarity - SLACK)
                yield [a for a, _ in edges], [b for _, b in edges]

        return packed(parts(), {"u": pa.int64(), "v": pa.int64()})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for ids, sets in _runs(batches, lambda t: shingles_of(t, shingle)[1]):
                edges = exact_forest(ids, sets, similarity)
                yield [a for a, _ in edges], [b for _, b in edges]

        return packed(parts(), {"u": pa.int64(), "v": pa.int64()})

    loose = connected_components(scan(dealt.select("tile", "rep", "sketch"), judge, "u long, v long").distinct())
    members = settle(loose.join(classes.selectExpr("rep AS node", "size"), "node").select("root", "node", "size"), "loose")
    # a shingle takes about six characters
    need = F.greatest(F.ceil(F.count("*") / bucket), F.ceil(F.sum("size") / (6 * SHINGLES))).alias("blocks")
    grouped = settle(members.join(members.groupBy("root").agg(need), "root").selectExpr("root", "node AS id", "blocks"), "loose-groups")
    texts = named.join(F.broadcast(grouped) if grouped.count() <= BROADCAST_ROWS else grouped, "id")
    links = scan(_tiles(texts, "root", "id").select("tile", "id", "t"), decide, "u long, v long").where("u <> v").distinct()
    return tied, links


def _tiles(members: DataFrame, group: str, member: str) -> DataFrame:
    """``members`` dealt by ``tile``: a group of several ``blocks`` has one tile for every two of its blocks.

    Any two members of a group meet in a tile; one of two blocks holds the pairs within either as well.
    """
    block = F.pmod(F.xxhash64(member, F.lit(3)), F.col("blocks"))
    other = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")))
    spread = members.withColumn("block", block).withColumn("other", F.explode(F.coalesce(other, F.array(F.lit(0).cast("long")))))
    tile = F.struct(group, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    return spread.withColumn("tile", tile).repartition("tile").sortWithinPartitions("tile", member)


def _runs(batches: Iterator[pa.RecordBatch], read: Callable = lambda value: value) -> Iterator[tuple[list, list]]:
    """(second column, third column as ``read``) of the rows of each tile that has two or more of them."""
    tile, ids, values = None, [], []
    for rows in batches:
        for t, i, v in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if t != tile:
                if len(ids) > 1:
                    yield ids, values
                tile, ids, values = t, [], []
            ids.append(i)
            values.append(read(v))
    if len(ids) > 1:
        yield ids, values


def _groups(keys: DataFrame) -> DataFrame:
    """(group, rep, n): texts that share a band, n of them; bands with the same texts are one group."""
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), *marks).where("n > 1")
    once = settle(shared.groupBy("n", "mark1", "mark2").agg(F.min("key").alias("key")).select("key", "n"), "groups")
    return keys.join(once, "key").select(F.col("key").alias("group"), "rep", "n")
