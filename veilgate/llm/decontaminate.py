"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m bytes that occurs in a text with at most e edits shares at least m - q + 1 - e q of
its q-grams with it, on diagonals that spread over at most e. So shared q-grams are counted per item in
diagonal bands 2 (e + 1) wide that overlap by half: every such occurrence lies in one band and reaches the
bound there. Bands that reach it are aligned, within the band and with free ends in the text; what needs
at most e edits is a leak.

Texts and items are compared as UTF-8 bytes after lower-casing and after turning runs of white space into
one blank. A q-gram of eight bytes is one 64-bit number, so a batch of texts is filtered by vector
operations. Items too short for that are looked for word for word by an automaton in the same scan. The
documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.llm.common import scan, unused

#: Bytes of a q-gram.
Q = 8
#: Edits allowed per byte of an item.
EDIT_RATE = 0.1
#: Items shorter than this after normalising leave too few q-grams for edits and are looked for word for word.
LEAST_BYTES = 24
#: Code points of scripts without blanks between words (Thai, Lao, Burmese, Khmer, Chinese, Japanese): a word may begin anywhere.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFF65, 0xFF9F), (0x20000, 0x3FFFF))
#: Bytes of benchmark text indexed and broadcast at once; a larger benchmark takes several blocks.
BLOCK_BYTES = 2 << 20
#: Hits expanded at a time.
PART = 1 << 21

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MAP_BITS = 21


def normalise(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def edit_budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item: the rate, but never more than leave one q-gram whole."""
    return max(0, min(int(rate * length), (length - Q) // Q))


def grams(data: bytes | bytearray) -> np.ndarray:
    """The q-gram starting at each byte, as numbers."""
    if len(data) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,)).astype(np.uint64)


class Index:
    """Q-grams of a block of benchmark items, sorted for lookup."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]], rate: float = EDIT_RATE):
        known = sorted({(i, normalise(t)) for i, t in items if i is not None})
        self.short = ahocorasick.Automaton()
        for i, t in known:
            if 0 < len(t) < LEAST_BYTES:
                self.short.add_word(t.decode(), (*self.short.get(t.decode(), ()), (i, len(t.decode()))))
        self.short.make_automaton()
        known = [(i, t) for i, t in known if len(t) >= LEAST_BYTES]
        self.ids = [i for i, _ in known]
        self.texts = [t for _, t in known]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.budgets = np.array([edit_budget(n, rate) for n in self.lengths], np.int64)
        self.bounds = self.lengths - Q + 1 - self.budgets * Q
        all_grams = [grams(t) for t in self.texts]
        gram = np.concatenate(all_grams) if known else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(known)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if known else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << _MAP_BITS, bool)
        self.present[self._slot(self.grams)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * _SPREAD) >> np.uint64(64 - _MAP_BITS)

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(position in data, number of the gram) where data has a q-gram of the benchmark."""
        found = grams(data)
        at = np.flatnonzero(self.present[self._slot(found)])
        found = found[at]
        number = np.searchsorted(self.grams, found)
        number[number == len(self.grams)] = 0
        same = self.grams[number] == found
        return at[same], number[same]


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> int | None:
    """Least edits of the whole item against a stretch of the text, on diagonals low..high; None if over budget."""
    width = high - low + 1
    padded = np.full(len(item) + width, -1, np.int16)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = np.frombuffer(text, np.uint8, b - a, a)
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i, byte in enumerate(item):
        best = row + (padded[i : i + width] != byte)
        np.minimum(best[:-1], row[1:] + 1, out=best[:-1])
        row = np.minimum.accumulate(best - steps) + steps
        if row.min() > budget:
            return None
    least = int(row.min())
    return least if least <= budget else None


def short_leaks(text: str, index: Index) -> list[tuple[int, int, int]]:
    """(item id, 0, byte of the text) of the short items that begin and end at borders of words."""
    if not len(index.short):
        return []

    def within(at: int) -> bool:
        """Whether a word goes on from the character before ``at`` to that at it."""
        sides = text[at - 1 : at + 1] if 0 < at < len(text) else ""
        return len(sides) == 2 and all(c.isalnum() and not any(a <= ord(c) <= b for a, b in UNSPACED) for c in sides)

    first: dict[int, int] = {}
    for last, ids in index.short.iter(text):
        for i, length in ids:
            if i not in first:
                at = last + 1 - length
                if not within(at) and not within(last + 1):
                    first[i] = at
    return [(i, 0, len(text[:at].encode())) for i, at in sorted(first.items())]


def leaks_of(texts: list[bytes], index: Index) -> list[list[tuple[int, int, int]]]:
    """Per text, (item id, edits, byte of the normalised text where the band begins) of each item found once."""
    out = [short_leaks(t.decode(), index) for t in texts]
    if not len(index.grams):
        return out
    gap = b"\xff" * Q
    data = gap.join(texts)
    starts = np.cumsum([0, *(len(t) + Q for t in texts[:-1])])
    at, number = index.hits(data)
    doc = np.searchsorted(starts, at, side="right") - 1
    n_items = len(index.ids)
    # one gram of a text may belong to many items: expand a bounded number of hits at a time, by whole texts
    weight = np.concatenate(([0], np.cumsum(index.count[number])))
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(weight[edges], weight[edges[first]] + PART, side="right")) - 1
        last = min(max(last, first + 1), first + max(1, (1 << 22) // n_items), len(texts))
        part = slice(edges[first], edges[last])
        for d, item, band in _bands(index, at[part], number[part], doc[part] - first, last - first, starts[first:last]):
            d += first
            budget = int(index.budgets[item])
            low = band * (budget + 1) - budget
            high = (band + 2) * (budget + 1) - 1 + budget
            edits = align(index.texts[item], texts[d], low, high, budget)
            if edits is not None:
                out[d].append((index.ids[item], edits, max(0, low)))
        first = last
    return [sorted({i: (i, e, a) for i, e, a in sorted(found, key=lambda x: (-x[1], -x[2]))}.values()) for found in out]


def _bands(index, at, number, doc, n_docs, starts) -> list[tuple[int, int, int]]:
    """(text, item, band) whose shared q-grams reach the bound of the item."""
    repeat = index.count[number]
    total = int(repeat.sum())
    if not total:
        return []
    offset = np.arange(total) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    entry = np.repeat(index.first[number], repeat) + offset
    item = index.owner[entry]
    doc_of = np.repeat(doc, repeat)
    pair = doc_of * len(index.ids) + item
    enough = np.bincount(pair, minlength=n_docs * len(index.ids))[pair] >= index.bounds[item]
    if not enough.any():
        return []
    pair, item, entry = pair[enough], item[enough], entry[enough]
    place = np.repeat(at - starts[doc], repeat)[enough]
    band = (place - index.place[entry]) // (index.budgets[item] + 1)
    base = np.int64(1) << 31
    keys = np.concatenate([pair * (base << 1) + band + base, pair * (base << 1) + band - 1 + base])
    keys, group, counts = np.unique(keys, return_inverse=True, return_counts=True)
    pair, band = keys // (base << 1), keys % (base << 1) - base
    item = pair % len(index.ids)
    # a gram of the item counts once, and so does a place of the text, however often either repeats
    likely = counts >= index.bounds[item]
    for side in (index.place[entry], place):
        mine = np.flatnonzero(likely[group])
        both = np.unique(group[mine] * np.int64(1 << 31) + np.concatenate([side, side])[mine])
        counts = np.bincount(both >> np.int64(31), minlength=len(keys))
        likely &= counts >= index.bounds[item]
    keep = likely
    return list(zip((pair[keep] // len(index.ids)).tolist(), item[keep].tolist(), band[keep].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Benchmark rows in blocks of bounded size, one at a time in the driver."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.select(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for block in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block).collect()]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: Sequence[str] | None = None,
    into: str = "leaks",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
) -> DataFrame:
    """The columns ``keep`` of every row of docs (all by default) and ``into array<struct<item_id, edits, at>>``.

    ``into`` lists the benchmark items the row's whole text holds, by id, with the least edits; it is empty for
    null and empty texts and when the benchmark is empty. Benchmark rows with a null id or text are ignored,
    repeated ones count once. A column of docs named ``into`` is replaced. Rows stay where they are: one scan
    per block of benchmark text, each block bounded, so a benchmark of any size is searched whole.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    leak = T.ArrayType(
        T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("at", T.LongType())])
    )
    arrow_leak = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("at", pa.int64())]))
    text, found = unused(keep, "text_of"), unused([*keep, unused(keep, "text_of")], "found")
    frame = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(text))
    frame = frame.withColumn(found, F.array().cast(leak))
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = context.broadcast(block)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, rate)
            for rows in batches:
                new = leaks_of([normalise(t) for t in rows.column(rows.num_columns - 2).to_pylist()], index)
                old = rows.column(rows.num_columns - 1).to_pylist()
                both = [
                    a + [{"item_id": i, "edits": e, "at": p} for i, e, p in b] for a, b in zip(old, new, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], pa.array(both, arrow_leak)], names=rows.schema.names
                )

        frame = scan(frame, each, frame.schema)
    return frame.select(*(F.col(f"`{c}`") for c in keep), F.array_sort(found).alias(into))
