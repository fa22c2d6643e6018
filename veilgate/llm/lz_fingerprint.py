"""Lempel-Ziv phrase fingerprints: likeness of documents as a compressor would see it.

A text is parsed from left to right into phrases, each the longest phrase known so far plus one character
(the last may be a known one). The set of phrases is what a compressor would have learned; the overlap of two
sets tells how well one text helps to compress the other. Of each set the smallest hashes are kept, and two
signatures estimate the overlap (Jaccard) of the sets.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import batch, scan

#: Hashes kept per text.
SIGNATURE = 128
#: Rows aimed at per range of ids when neighbours are brought together, and the most ranges.
RANGE_ROWS, MAX_RANGES = 1024, 4096

NAMES = {
    "doc_id": "long",
    "n_chars": "long",
    "edited_sha256": "string",
    "fingerprint": "string",
    "edited_fingerprint": "string",
    "near_edited": "double",
    "near_next": "double",
}
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t] for t in NAMES.values()]


class Parser:
    """Dictionary phrases of a growing text and their hashes."""

    def __init__(self, known: set[str] | None = None, rest: str = "", hashes: list[np.ndarray] | None = None):
        self.known = set() if known is None else known
        self.rest = rest
        self.hashes = [] if hashes is None else hashes

    def feed(self, text: str) -> Parser:
        known, found, current = self.known, [], self.rest
        for character in text:
            current += character
            if current not in known:
                known.add(current)
                found.append(current)
                current = ""
        self.rest = current
        self.hashes.append(phrase_hashes(found))
        return self

    def fork(self) -> Parser:
        return Parser(set(self.known), self.rest, list(self.hashes))

    def signature(self, size: int = SIGNATURE) -> np.ndarray:
        """The smallest ``size`` hashes of the phrases, ascending."""
        return distinct(np.concatenate(self.hashes))[0][:size]


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hashes, equal in every process: CRC-32 of the UTF-8 bytes, then mixed so that the order is random."""
    state = np.fromiter(map(zlib.crc32, map(str.encode, phrases)), np.uint32, len(phrases))
    state ^= state >> np.uint32(16)
    state *= np.uint32(0x7FEB352D)
    state ^= state >> np.uint32(15)
    state *= np.uint32(0x846CA68B)
    return state ^ (state >> np.uint32(16))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and whether each occurs more than once."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    repeated = np.zeros(len(values), bool)
    repeated[:-1] = ~first[1:]
    return values[first], repeated[first]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    """Share of common hashes among the smallest of both; 1 for two empty texts, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, repeated = distinct(np.concatenate((a, b)))
    return float(repeated[: min(size, len(both))].mean())


def to_hex(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(text: str | None, size: int = SIGNATURE) -> np.ndarray:
    return Parser().feed(text or "").signature(size)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIGNATURE) -> DataFrame:
    """(``id_col``, fingerprint string) per row over the whole text: 8 hex digits a hash, ascending; a null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [to_hex(fingerprint(t, size)) for t in rows.column(1).to_pylist()]
            yield batch({id_col: (rows.column(0), None), "fingerprint": (found, pa.string())})

    keyed = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return scan(keyed, each, f"`{id_col}` {keyed.schema[0].dataType.simpleString()}, fingerprint string")


def compare(own: str, following: str, size: int = SIGNATURE) -> tuple:
    """(signature, digest of the edited text, its signature, likeness of both); the common start is parsed once."""
    n = len(own)
    cut = n // 2
    head, tail = own[: n - cut], following[:cut]
    parser = Parser().feed(head)
    b = parser.fork().feed(tail).signature(size)
    a = parser.feed(own[n - cut :]).signature(size)
    digest = hashlib.sha256((head + tail).encode()).hexdigest()
    return a, digest, b, likeness(a, b, size)


def _range_of(docs: DataFrame) -> Column:
    """Number of the range an id falls into, ranges counted from the largest ids down, each with about as many rows.

    There are at most MAX_RANGES, so the borders kept in the plan do not grow with the data. They are searched in
    two steps. Rows without an id come last, in 64 ranges by hash.
    """
    ids = docs.select("id").where("id IS NOT NULL")
    parts = min(MAX_RANGES, -(-ids.count() // RANGE_ROWS))
    marks = [k / parts for k in range(1, parts)]
    borders = ids.agg(F.percentile_approx("id", marks, 20 * parts)).first()[0] if marks else []
    borders = sorted(set(borders or []), reverse=True)
    step = max(1, math.isqrt(len(borders)))
    groups = [borders[k : k + step] for k in range(0, len(borders), step)]

    def numbers(values: list) -> Column:
        return F.array(*(F.lit(int(v)) for v in values)).cast("array<bigint>")

    def above(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: F.col("id") < b))

    first = above(numbers([g[-1] for g in groups]))
    second = F.when(
        first < len(groups), above(F.element_at(F.array(*(numbers(g) for g in groups or [[]])), F.least(first + 1, F.lit(max(1, len(groups))))))
    ).otherwise(0)
    lost = F.lit(len(borders) + 1) + F.shiftright("h", 58) + 32
    return F.when(F.col("id").isNull(), lost).otherwise(first * step + second).cast("int")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIGNATURE) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller id, after the last the first; rows with equal ids follow
    each other by a hash of the text, rows without an id come last. The texts move once: rows are dealt by ranges
    of ids, the first row of each range is also sent to the range before it, and a task reads its ranges in order
    as a stream, holding two texts at a time. A single document follows itself; an empty table stays empty.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")
    ).withColumns({"h": F.xxhash64("t"), "o": F.coalesce(-F.col("id"), F.lit((1 << 63) - 1))})
    dealt = rows.withColumn("r", _range_of(rows))
    heads = dealt.groupBy("r").agg(F.min(F.struct("o", "h")).alias("k")).orderBy("r").collect()
    known = [(row.r, row.k.o, row.k.h, heads[k - 1].r) for k, row in enumerate(heads)]
    head = docs.sparkSession.createDataFrame(known, "r int, head_o long, head_h long, before int")
    own = F.struct("r", F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("r"), F.lit(True).alias("guest"))
    first = (F.col("o") == F.col("head_o")) & (F.col("h") == F.col("head_h"))
    sent = dealt.join(F.broadcast(head), "r").select(
        F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("to"), "o", "h", "id", "t"
    )
    ordered = sent.select("to.r", "to.guest", "o", "h", "id", "t").repartition("r")
    ordered = ordered.sortWithinPartitions("r", "guest", "o", "h").select("r", "guest", "id", "t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = waiting = None  # the last row, and the row before it that lacks the signature of the last
        for rows in batches:
            out: list[tuple] = []
            for place, is_guest, number, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if held is not None:
                    mine, digest, edited, near = compare(held[1], text, size)
                    if waiting is not None:
                        out.append((*waiting[:-1], likeness(waiting[-1], mine, size)))
                    waiting = (held[0], len(held[1]), digest, to_hex(mine), to_hex(edited), near, mine)
                    if is_guest:
                        out.append((*waiting[:-1], likeness(mine, fingerprint(text, size), size)))
                        waiting = None
                held = None if is_guest else (number, text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in out], t) for k, t in enumerate(TYPES)], names=list(NAMES)
            )

    return scan(ordered, each, ", ".join(f"{n} {t}" for n, t in NAMES.items()))
