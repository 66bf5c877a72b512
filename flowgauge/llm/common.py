"""Small pieces that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowgauge.session import scratch_path

BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession, limit: str = BATCH_BYTES) -> None:
    """Bound an Arrow batch by bytes too, so that very long texts never pile up in a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "", "-1", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Evaluate once into the shared folder and read the written table back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without building str objects."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def grown(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of a table with more fields at its end."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with columns added at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; an empty segment sums to zero."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(lengths)
    if len(full):
        ends = np.cumsum(lengths[full])
        out[full] = np.add.reduceat(values, np.concatenate([[0], ends[:-1]]), axis=0)
    return out


def runs(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes stay within the budget; a larger single item is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
