"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are counted over the whole text, in a scan without a shuffle. The trees are grown on a bounded
sample of labelled rows and flattened into arrays; scoring walks all trees for a batch of rows by array
indexing. Language, source, ids and labels are no statistics.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.llm.common import scan, unused

#: Most labelled rows a model is fitted on; which ones is decided by a hash of the id.
SAMPLE_ROWS = 20_000
#: Rows of the fold that is never learned from: crc32 of the id as text, modulo 3, is 1.
HELD_OUT = "coalesce(crc32(CAST(CAST(`{id}` AS STRING) AS BINARY)) % 3 = 1, false)"

FEATURES = (
    "log_chars", "log_words", "letter_share", "upper_share", "digit_share", "blank_share", "newline_share",
    "mark_share", "sentence_share", "comma_share", "exclaim_share", "hash_share", "bar_share", "other_share",
    "high_share", "mean_word", "long_word_share", "one_letter_share", "distinct_words", "top_word_share",
    "upper_words", "marked_words", "log_lines", "distinct_lines", "repeated_line_chars", "mean_line",
    "short_line_share", "ended_line_share", "distinct_pairs", "distinct_triples",
)

_CLASS = np.zeros(256, np.uint8)
for _number, _members in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".?;:", b",", b"!", b"#$%&*@^~", b"|<>{}[]\\/=_+"),
    1,
):
    _CLASS[list(_members)] = _number
_CLASS[128:] = 11


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; all zero for a text without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(data)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=12) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in data.split(b"\n") if line.strip()]
    line_counts: dict[bytes, int] = {}
    for line in lines:
        line_counts[line] = line_counts.get(line, 0) + 1
    m = len(words)
    upper = sum(map(bytes.isupper, words))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?" for w in words)
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, m - 2)
    return [
        np.log1p(n), np.log1p(m), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[0], kinds[6], kinds[7], kinds[8],
        kinds[9], kinds[10], kinds[0] + kinds[8] + kinds[9] + kinds[10], kinds[11], lengths.mean(), (lengths > 12).mean(),
        (lengths == 1).mean(), len(counts) / m, max(counts.values()) / m, upper / m, marked / m, np.log1p(len(lines)),
        len(line_counts) / len(lines), sum((c - 1) * len(k) for k, c in line_counts.items()) / n, n / len(lines),
        sum(len(x) < 40 for x in lines) / len(lines), sum(x.rstrip()[-1:] in b".?!\"'" for x in lines) / len(lines),
        pairs, triples,
    ]


@dataclass
class Forest:
    """Boosted trees as arrays of shape (trees, nodes); node 0 is the root, a leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row, all trees at once, in bounded blocks of rows."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.value))[None, :]
        for at in range(0, len(x), 1024):
            block = x[at : at + 1024]
            rows = np.arange(len(block))[:, None]
            node = np.zeros((len(block), trees.shape[1]), np.int64)
            for _ in range(self.depth):
                below = block[rows, self.feature[trees, node]] <= self.threshold[trees, node]
                node = np.where(below, self.left[trees, node], self.right[trees, node])
            out[at : at + 1024] += self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def boost(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    least: int = 12,
    ridge: float = 1.0,
) -> Forest:
    """Histogram gradient boosting of the logistic loss. Ties between splits go to the first feature and bin.

    No rows give the score 0.5, rows of a single label the smoothed share of that label.
    """
    n, f = x.shape
    nodes = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes))
    itself = np.tile(np.arange(nodes), (trees, 1))
    left, right, value = itself.copy(), itself.copy(), np.zeros((trees, nodes))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    forest = Forest(base, feature, threshold, left, right, value, depth)
    if n == 0 or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(f) * bins
    total = np.full(n, base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            for own in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(node == own)
                if len(mine) < 2 * least:
                    continue
                index = flat[mine].ravel()
                g = np.bincount(index, np.repeat(gradient[mine], f), f * bins).reshape(f, bins).cumsum(axis=1)
                h = np.bincount(index, np.repeat(weight[mine], f), f * bins).reshape(f, bins).cumsum(axis=1)
                c = np.bincount(index, minlength=f * bins).reshape(f, bins).cumsum(axis=1)
                g_all, h_all = g[0, -1], h[0, -1]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain[(c < least) | (len(mine) - c < least)] = -1
                for j, cut in enumerate(cuts):
                    gain[j, len(cut) :] = -1
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-9:
                    continue
                j, b = divmod(best, bins)
                feature[tree, own], threshold[tree, own] = j, cuts[j][b]
                left[tree, own], right[tree, own] = 2 * own + 1, 2 * own + 2
                node[mine] = np.where(binned[mine, j] <= b, 2 * own + 1, 2 * own + 2)
        g = np.bincount(node, gradient, nodes)
        h = np.bincount(node, weight, nodes)
        value[tree] = -rate * g / (h + ridge)
        total += value[tree][node]
    return forest


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Forest:
    """A forest for ``label_col``, learned from at most ``sample_rows`` labelled rows outside the held-out fold.

    Rows with a null id or label are left out; several labels of one id are averaged, a half counts as 1; an
    id that occurs in several rows of docs is learned once per row. The sample's bound is checked before the
    ids are broadcast and the statistics (30 numbers a row) brought to the driver.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .where(f"NOT {HELD_OUT.format(id=id_col)}")
        .groupBy(F.col(id_col).alias("__id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample_rows)
    )
    named = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    chosen = named.join(F.broadcast(known), "__id").select("__y", "__text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [statistics(t) for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    rows = scan(chosen, each, "y int, x array<double>")
    local = rows.orderBy(F.xxhash64("x", "y")).limit(sample_rows).collect()
    x = np.array([r.x for r in local], float).reshape(len(local), len(FEATURES))
    return boost(x, np.array([r.y for r in local], float))


def score(
    docs: DataFrame, forest: Forest, text_col: str = "text", keep: Sequence[str] | None = None, into: str = "score"
) -> DataFrame:
    """The columns ``keep`` of every row (all by default) and ``into double``: how likely its label is 1.

    Null and empty texts are scored like a text whose statistics are all zero. A column of docs named
    ``into`` is replaced. One scan, no shuffle.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != into]
    frame = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(unused(keep, "text_of")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(rows.num_columns - 1).to_pylist()
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(forest.score(x), pa.float64())], names=[*keep, into]
            )

    schema = T.StructType([*frame.schema.fields[:-1], T.StructField(into, T.DoubleType())])
    return scan(frame, each, schema)
