"""What the corpus operators share: bounded Arrow scans over text columns and table access."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch handed to Python; a longer single row travels alone.
BATCH_BYTES = 4 << 20
#: Rows of one Arrow batch of short rows.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column is called so; Spark does not tell upper from lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose batches are bounded in bytes, so memory follows the batch, not the data."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(each, schema)


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from name -> (values, type)."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()],
        names=list(columns),
    )


def packed(parts: Iterable[tuple], fields: dict[str, pa.DataType], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of a fair size from many small parts, each a tuple of equally long columns."""
    waiting: list[list[pa.Array]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = [pa.concat_arrays([part[k] for part in waiting]) for k in range(len(fields))]
        return pa.RecordBatch.from_arrays(columns, names=list(fields))

    for part in parts:
        arrays = [pa.array(c, type=t) for c, t in zip(part, fields.values(), strict=True)]
        if len(arrays[0]):
            waiting.append(arrays)
            size += len(arrays[0])
        if size >= rows:
            yield flush()
            waiting, size = [], 0
    if waiting:
        yield flush()
