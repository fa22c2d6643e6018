"""Byte-level BPE encoding and decoding with a local rank file.

The rank file is read once by the driver, checked for size and broadcast; every Python worker builds
one tokenizer from it. Long texts are cut where no match of the pre-split pattern can cross, so the
regular expression and the merge step work on bounded pieces and the ids equal those of the whole
text; long runs of white space are matched by the pattern's own rule and only merged by the library. Decoding joins raw bytes; a token may hold part of a character, so text is never decoded piece
by piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgate.llm.common import scan

#: Largest rank file that is broadcast; public vocabularies have 1 to 5 MB.
MAX_RANK_BYTES = 64 << 20
#: Code points after which a text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: Code points of white space from which a run is matched here and not by the library, whose stack would not hold it.
BLANK_RUN = 1 << 12

#: A blank or line feed behind a letter or digit, and white space as the pre-split pattern has it.
_CUT = re.compile(r"(?<=[^\W_])[ \n]")
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_ENCODINGS: dict[tuple[int, str], tiktoken.Encoding] = {}


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 token and number."""
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in raw.splitlines() if line.strip())}


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of at least ``limit`` code points, cut before a blank or line feed that follows a letter or digit.

    A pre-split match holds white space only at its start or consists of white space, so a match ends
    after the letter and the next one begins with the white space: the matches of the pieces are those
    of the text. A text without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > limit:
        found = _CUT.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < n or n == 0:
        yield text[start:]


def blank_runs(text: str, least: int = BLANK_RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts, and whether a part is one match of white space.

    By the pattern a run of white space before other text is one match but for its last character, which the next match
    begins with if it is a blank, and which is a match of its own otherwise; a run at the end is one match. So
    long runs are cut out and the last character stays with what follows.
    """
    start = 0
    for run in re.compile(f"[{_BLANK}]{{{least},}}").finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > start:
            yield text[start : run.start()], False
        yield text[run.start() : end], True
        start = end
    if start < len(text):
        yield text[start:], False


def encode(encoding: tiktoken.Encoding, text: str, limit: int = PIECE_CHARS, run: int = BLANK_RUN) -> list[int]:
    """The ids of a text as the library gives them, for texts of any length and with runs of white space of any length."""
    ids: list[int] = []
    for part, blank in blank_runs(text, run):
        if blank:
            ids += encoding._encode_single_piece(part)  # the merge step alone
        else:
            for piece in safe_pieces(part, limit):
                ids += encoding.encode_ordinary(piece)
    return ids


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = PIECE_CHARS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``ids array<int>`` and ``decoded binary`` (the ids turned back into bytes).

    Special tokens are ordinary text. A null or empty text has no ids and empty bytes. Ids may be null or
    repeated; other columns are ignored, whatever their names. Nothing is shuffled.
    """
    with open(vocabulary, "rb") as file:
        raw = file.read()
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file has {len(raw)} bytes; at most {MAX_RANK_BYTES} are broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def worker() -> tiktoken.Encoding:
        key = (hash(shared.value), pattern)
        if key not in _ENCODINGS:
            _ENCODINGS[key] = tiktoken.Encoding(
                "ranks", pat_str=pattern, mergeable_ranks=parse_ranks(shared.value), special_tokens={}
            )
        return _ENCODINGS[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = worker()
        for rows in batches:
            ids = [encode(encoding, text, limit) if text else [] for text in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([encoding.decode_bytes(x) for x in ids], pa.binary()),
                ],
                names=[id_col, "ids", "decoded"],
            )

    keyed = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = keyed.schema[0].dataType.simpleString()
    return scan(keyed, each, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digests(tokens: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Counts and digests of ``encode_decode`` rows, computed by Spark; with the ids themselves if asked."""
    return tokens.select(
        id_col,
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
