"""Vector expressions over ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: output sizes of the embedding models ---------------------------------------

MODEL_DIMENSIONS = {
    "amazon.titan-embed-text-v2:0": 1536,
    "amazon.titan-embed-text-v1": 1536,
    "cohere.embed-english-v3": 1024,
    "cohere.embed-multilingual-v3": 1024,
}
DEFAULT_MODEL = "amazon.titan-embed-text-v2:0"

#: Dimension from which pseudo components are made in Arrow batches, and vectors at once in these.
WIDE, WIDE_ROWS = 256, 256

# ----------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 - cosine distance; a zero vector is similar to nothing (0)."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def scaled(vector: Column, length: Column) -> Column:
    """Divide a vector by an already computed length; a zero vector stays as it is."""
    return F.transform(
        vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))
    )


def has_dimension(vector: Column, dimension: int) -> Column:
    """False for null, too short and too long vectors."""
    return F.coalesce(F.size(vector) == dimension, F.lit(False))


def _wide_components(dimension: int):
    ends = [b":%d" % i for i in range((dimension + 15) // 16)]

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), WIDE_ROWS):
                keys = [None if key is None else key.encode() for key in batch.slice(at, WIDE_ROWS).to_pylist()]
                digests = b"".join(hashlib.sha256((key or b"") + end).digest() for key in keys for end in ends)
                numbers = np.frombuffer(digests, dtype=">u2").reshape(len(keys), -1)[:, :dimension] / 32768 - 1
                unknown = np.repeat([key is None for key in keys], dimension)
                yield pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype="int32") * dimension, pa.array(numbers.reshape(-1), mask=unknown))

    return run


def pseudo_components(key: Column, dimension: int) -> Column:
    """Reproducible numbers in [-1, 1) from a text key, one 4-digit hex group per component.

    Stands in for a model where none is attached: equal texts get equal vectors. The key is evaluated once
    (as the one element of an array), not once per block, and a digest is read as four numbers of 64 bits.
    Wide vectors are made in Arrow batches, which takes a fifth of the time.
    """
    if dimension >= WIDE:
        return _wide_components(dimension)(key)

    def components(known: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.lit((dimension + 15) // 16 - 1)), lambda i: F.sha2(F.concat(known, F.lit(":"), i.cast("string")), 256)
        )
        starts = F.array(*[F.lit(at) for at in (1, 17, 33, 49)])
        wide = F.transform(
            blocks, lambda digest: F.transform(starts, lambda at: F.conv(F.substr(digest, at, F.lit(16)), 16, -10).cast("long"))
        )
        numbers = F.transform(
            F.flatten(wide),
            lambda w: F.array(*[F.shiftrightunsigned(w, n).bitwiseAND(F.lit(65535)) / 32768.0 - 1.0 for n in (48, 32, 16, 0)]),
        )
        return F.slice(F.flatten(numbers), 1, dimension)

    return F.element_at(F.transform(F.array(key), components), 1)
