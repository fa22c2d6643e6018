"""Alignment of two tokenizers by interval coalescing, with corpus-wide counts of the id pairs.

Both tokenizers cut the same bytes, so a batch of texts is two rows of intervals. All A and B tokens are sorted by
start; a group ends where a start reaches the running maximum of the ends. Within a group every further token opens
one overlap, with the token of the other side that is open there.

A text's distinct pairs are kept once, with how often they occur. Counts are added up per task before they are shuffled.
The most frequent pairs, at most TOP, are broadcast and looked up in Arrow; pairs beyond them are joined by a shuffle.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veilgate.llm import byte_bpe
from veilgate.llm.common import batch, packed, scan
from veilgate.session import settle

#: Largest vocabulary file that is broadcast.
MAX_FILE_BYTES = 64 << 20
#: Pairs whose counts are broadcast (17 bytes each); the rest is joined.
TOP = 1 << 20
#: Code points after which a text is cut at the next safe place, and code points tokenised at once.
PIECE_CHARS = 1 << 16
SLICE_CHARS = 1 << 18
#: Pairs of a task counted at once.
COUNTED = 1 << 21

#: The pattern by which byte-level vocabularies of this kind split texts (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE = "▁"
_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_WORKERS: dict[int, Pair] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        alphabet = byte_alphabet()
        words = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in word) if all(c in alphabet for c in word) else b""
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(_SPACE, " ").encode() for i, name in enumerate(names)
        ]
        # texts may be cut between words for B if no token reaches from a word into the blank behind it
        self.cuts = not any(_SPACE in n.lstrip(_SPACE) for n in names)
        self.ranked = self._ranked(json.loads(byte_level), words)
        self.sizes = tuple(np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.flat = tuple(np.frombuffer(b"".join(side), np.uint8) for side in (self.a_bytes, self.b_bytes))
        self.written = tuple(
            np.array([b"%s%d" % (mark, i) for mark in marks for i in range(len(side))], object)
            for marks, side in (((b",", b";"), self.a_bytes), ((b",", b"|"), self.b_bytes))
        )

    def _ranked(self, described: dict, words: dict[str, int]) -> tiktoken.Encoding | None:
        """The byte-level vocabulary as ranks, which are faster, if its ids are in the order of its merges and its texts are
        split by the usual pattern; else None."""
        merges = [m if isinstance(m, str) else " ".join(m) for m in described["model"].get("merges", [])]
        ids = [words.get(m.replace(" ", ""), -1) for m in merges]
        known = {i for i in words.values() if len(self.a_bytes[i]) == 1}
        split = described.get("pre_tokenizer") or {}
        usual = described.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not usual or len(known) != 256 or ids != list(range(max(known) + 1, max(known) + 1 + len(ids))):
            return None
        ranks = {self.a_bytes[i]: i for i in [*known, *ids]}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(ids) else None

    def a_ids(self, text: str) -> np.ndarray:
        if self.ranked is None:
            return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        if len(text) < byte_bpe.BLANK_RUN:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(byte_bpe.encode(self.ranked, text), np.int64)

    def pieces(self, text: str, limit: int) -> Iterator[str]:
        """The text cut before blanks between letters or digits, without those blanks (B puts one before each piece)."""
        start = 0
        while self.cuts and len(text) - start > limit:
            found = _CUT.search(text, start + limit)
            if not found:
                break
            yield text[start : found.start()]
            start = found.end()
        yield text[start:]

    def bytes_of(self, side: int, ids: np.ndarray) -> bytes:
        """The bytes of some tokens, joined."""
        size, ends = self.sizes[side], np.cumsum(self.sizes[side])
        long = size[ids]
        to = np.cumsum(long)
        return self.flat[side][np.arange(to[-1] if len(to) else 0) + np.repeat(ends[ids] - to, long)].tobytes()

    def encode(self, texts: Sequence[str], limit: int = PIECE_CHARS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where the bytes of either differ from a blank and the text."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        cut = [list(self.pieces(t, limit)) for t in texts]
        flat = self.b.encode([p for parts in cut for p in parts], num_threads=1)
        out, at = [], 0
        for text, parts in zip(texts, cut, strict=True):
            sides = self.a_ids(" " + text), np.concatenate([np.array(ids, np.int64) for ids in flat[at : at + len(parts)]])
            at += len(parts)
            want = b" " + text.encode()
            same = text and all(self.bytes_of(k, ids) == want for k, ids in enumerate(sides))
            out.append(sides if same else none)
        return out


def _file(path: str) -> bytes:
    if os.path.getsize(path) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than the {MAX_FILE_BYTES} bytes that are broadcast")
    with open(path, "rb") as file:
        return file.read()


# one batch of texts -----------------------------------------------------------------------------------


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, links) of two rows of token sizes with equal sums.

    ``links`` has a row (A token, B token) for each two that overlap. Sizes are 1 or more.
    """
    ends = np.concatenate((np.cumsum(a_sizes), np.cumsum(b_sizes)))
    starts = ends - np.concatenate((a_sizes, b_sizes))
    side = np.repeat(np.array([0, 1], np.int8), (len(a_sizes), len(b_sizes)))
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    first = np.ones(len(order), bool)
    first[1:] = starts[order][1:] >= reach[:-1]
    group = np.cumsum(first) - 1
    of_b = side[order] == 1
    open_a, open_b = np.cumsum(~of_b) - 1, np.cumsum(of_b) - 1
    return group[~of_b], group[of_b], np.column_stack((open_a, open_b))[~first]


def _texts(group_a: np.ndarray, group_b: np.ndarray, a: np.ndarray, b: np.ndarray, written: tuple[np.ndarray, ...]) -> list[bytes]:
    """The tokens of all groups in writing order, A before B, each with the mark that stands before it."""
    first_a = np.diff(group_a, prepend=-1).astype(np.int64)
    first_b = np.diff(group_b, prepend=-1).astype(np.int64)
    out = np.empty(len(a) + len(b), object)
    table_a, table_b = written
    out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = table_a[first_a * (len(table_a) // 2) + a]
    out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = table_b[first_b * (len(table_b) // 2) + b]
    return out.tolist()


def align(tokens: Sequence[tuple[np.ndarray, np.ndarray]], pair: Pair) -> dict[str, tuple]:
    """Columns of the alignment of some texts: counts, the groups in writing, distinct pairs and how often each occurs."""
    n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    group_a, group_b, links = coalesce(pair.sizes[0][a], pair.sizes[1][b])
    text_a = np.repeat(np.arange(len(tokens)), n_a)
    groups = np.bincount(text_a[np.diff(group_a, prepend=-1) > 0], minlength=len(tokens))
    # distinct pairs of each text
    wide = len(pair.a_bytes) * len(pair.b_bytes)
    code = text_a[links[:, 0]] * wide + a[links[:, 0]] * len(pair.b_bytes) + b[links[:, 1]]
    code, times = np.unique(code, return_counts=True)
    ends = np.searchsorted(code, np.arange(len(tokens) + 1) * wide).astype(np.int32)
    code %= wide
    joined = _texts(group_a, group_b, a, b, pair.written)
    cuts = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (code // len(pair.b_bytes), code % len(pair.b_bytes), times)]
    return {
        "n_a": (n_a, pa.int64()),
        "n_b": (n_b, pa.int64()),
        "n_groups": (groups, pa.int64()),
        "n_links": (n_a + n_b - groups, pa.int64()),
        "groups": ([b"".join(joined[x:y])[1:] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        **dict(zip("abm", ((v, None) for v in lists), strict=True)),
    }


# the operator -----------------------------------------------------------------------------------------


def alignments(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", limit: int = PIECE_CHARS
) -> DataFrame:
    """One row per text: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups (in writing), and the
    distinct linked id pairs as arrays a, b and m (how often).

    ``byte_level`` and ``pieces`` are the files of the tokenizers. Null and empty texts and texts one side cannot give
    back byte for byte have no tokens. Texts are cut between words for tokenising, which changes no token; what has no
    blank between ASCII letters or digits is tokenised in one go by B. Nothing is shuffled.
    """
    files = _file(byte_level), _file(pieces)
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def worker() -> Pair:
        key = hash(shared.value)
        if key not in _WORKERS:
            _WORKERS[key] = Pair(*shared.value)
        return _WORKERS[key]

    def slices(rows: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        taken, size, start = [], 0, 0
        for k, text in enumerate(rows.column(1).to_pylist()):
            taken.append(text or "")
            size += len(taken[-1])
            if size >= SLICE_CHARS:
                yield start, taken
                taken, size, start = [], 0, k + 1
        if taken:
            yield start, taken

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seen = worker(), TaskContext.get().partitionId() << 40
        for rows in batches:
            for start, texts in slices(rows):
                yield batch(
                    {
                        "row": (np.arange(seen, seen + len(texts)), pa.int64()),
                        "id": (rows.column(0).slice(start, len(texts)), None),
                        **align(pair.encode(texts, limit), pair),
                    }
                )
                seen += len(texts)

    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    arrays = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in "abm"]
    schema = T.StructType([T.StructField("row", T.LongType()), keyed.schema[0], *longs, T.StructField("groups", T.BinaryType()), *arrays])
    return scan(keyed, each, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many rows hold a linked id pair, and whether that is the most among the pairs of its A id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted():
            code, docs = np.unique(np.concatenate(waiting), return_counts=True)
            return batch({"a": (code >> 32, pa.int32()), "b": (code & 0xFFFFFFFF, pa.int32()), "docs": (docs, pa.int64())})

        for rows in batches:
            a, b = (rows.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            waiting.append(a << 32 | b)
            size += len(a)
            if size > COUNTED:
                yield counted()
                waiting, size = [], 0
        if size:
            yield counted()

    found = scan(aligned.select("a", "b"), each, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    found = settle(found, "pair-counts")
    most = found.groupBy("a").agg(F.max("docs").alias("most"))  # one row per A id, so no more than the vocabulary
    return found.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, top: int) -> tuple[list[np.ndarray], int]:
    """([codes, docs, best] of the most frequent pairs, sorted by code, at most ``top``; least docs they have)."""
    steps = counts.groupBy(F.floor(F.log2("docs") * 16).alias("step")).agg(F.count("*").alias("n"), F.min("docs").alias("least"))
    taken, least = 0, 1 << 62
    for step in sorted(steps.collect(), key=lambda r: -r.step):
        if taken + step.n > top:
            break
        taken, least = taken + step.n, step.least
    rows = counts.where(F.col("docs") >= least).toArrow()
    code = rows["a"].to_numpy().astype(np.int64) << 32 | rows["b"].to_numpy()
    order = np.argsort(code)
    return [code[order], rows["docs"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]], least


def score_links(aligned: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """``aligned`` (a stored table) without its pairs, with n_best and count_sum over its links by ``counts``."""
    frequent, least = _frequent(counts, top)
    shared = aligned.sparkSession.sparkContext.broadcast(frequent)
    kept = [c for c in aligned.columns if c not in "abm"]

    def looked_up(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        a, b, m = (rows.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
        code, (codes, docs, best) = a << 32 | b, shared.value
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        of = np.repeat(np.arange(rows.num_rows), rows.column(1).value_lengths().to_numpy())
        return of, code, m, known, docs[at[known]], best[at[known]]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            of, _, m, known, docs, best = looked_up(rows)
            sums = np.zeros((2, rows.num_rows), np.int64)
            np.add.at(sums[0], of[known], m[known] * best)
            np.add.at(sums[1], of[known], m[known] * docs)
            yield batch({"row": (rows.column(0), None), "n_best": (sums[0], pa.int64()), "count_sum": (sums[1], pa.int64())})

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for rows in batches:
                of, code, m, known, _, _ = looked_up(rows)
                row = rows.column(0).to_numpy()[of[~known]]
                yield row, (code >> 32)[~known], (code & 0xFFFFFFFF)[~known], m[~known]

        return packed(parts(), {"row": pa.int64(), "a": pa.int32(), "b": pa.int32(), "m": pa.int64()})

    linked = aligned.select("row", "a", "b", "m")
    if least > 1 and not counts.where(F.col("docs") < least).isEmpty():
        rare = scan(linked, rest, "row long, a int, b int, m long").join(counts, ["a", "b"])
        more = rare.groupBy("row").agg(F.sum(F.col("m") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("m") * F.col("docs")).alias("count_sum"))
        sums = scan(linked, summed, "row long, n_best long, count_sum long").unionByName(more)
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return aligned.select(kept).join(sums, "row").drop("row")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            pairs = rows.select(["row", "a", "b", "m"])
            sums = next(summed(iter([pairs])))
            columns = [*(rows.column(c) for c in kept), sums.column(1), sums.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum"])

    fields = [aligned.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
    return scan(aligned, whole, T.StructType(fields)).drop("row")


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP
) -> DataFrame:
    """One row per input row: ``id_col``, n_a, n_b, n_groups, n_links, groups (in writing), n_best, count_sum.

    See ``alignments`` for texts without tokens. Ids may be null or repeated, repeated rows count and come back
    repeatedly, other columns are ignored, an empty table gives an empty one.
    """
    aligned = settle(alignments(docs, byte_level, pieces, id_col, text_col), "aligned")
    return score_links(aligned, settle(pair_counts(aligned), "pairs"), top).withColumnRenamed("id", id_col)
