"""DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

from twinlink.session import ensure_checkpoint_dir, scratch_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again; cuts lineage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_struct(df: DataFrame, name: str = "doc") -> DataFrame:
    """All columns of ``df`` in one struct column, so that added columns clash with none."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias(name))


def with_fields(df: DataFrame, fields: str, name: str = "doc") -> StructType:
    """Schema of ``as_struct(df)`` followed by ``fields`` (a DDL string)."""
    more = StructType.fromDDL(fields)
    return StructType([StructField(name, df.schema), *more.fields])


def field_of(column: pa.StructArray, at: int):
    """Field number ``at`` of a struct array (null-free at the top), slices respected."""
    return column.field(at) if column.offset == 0 else column.flatten()[at]


def batch_of(arrays: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)


PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, texts: pa.Array, limit: int = PIECE_BYTES):
    """``batch`` cut into runs of rows with at most ``limit`` bytes (or one row) of its string column ``texts``."""
    sizes = texts.cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:sizes.offset + len(sizes) + 1] if len(sizes) else ()
    first = 0
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1, first + 1)
        yield batch.slice(first, last - first)
        first = last


def pieces_of(batch: pa.RecordBatch, at: int, limit: int = PIECE_BYTES):
    """``pieces`` by string field ``at`` of the batch's struct."""
    return pieces(batch, field_of(batch.column(0), at), limit)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return what this worker has freed to the system: workers outlive their tasks, and what the tasks of
    several stages leave behind would add up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def bounded(work, texts_of, limit: int = PIECE_BYTES):
    """``work`` (for mapInArrow) fed with batches of at most ``limit`` bytes of text, so that what it holds in Python
    does not depend on rows a batch; freed memory goes back at the end of the task."""
    def run(batches):
        try:
            yield from work(piece for batch in batches for piece in pieces(batch, texts_of(batch), limit))
        finally:
            give_back()
    return run


def replace_field(column: pa.StructArray, at: int, values: pa.Array) -> pa.StructArray:
    """The struct array with field ``at`` replaced."""
    kind = column.type
    own = [values if k == at else field_of(column, k) for k in range(kind.num_fields)]
    return pa.StructArray.from_arrays(own, fields=[kind.field(k) for k in range(kind.num_fields)])


SMALL_BYTES = 64 << 20


def _width(field: StructField) -> Column:
    """Bytes of a column's value: the length of texts, eight for numbers, the JSON text of what is nested."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 8
    return F.lit(8)


def small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """``df`` (a written table) marked for a broadcast join if its measured bytes are at most
    ``limit``; else as it is, for a shuffle join."""
    size = df.select(sum((_width(f) for f in df.schema.fields), F.lit(16)).alias("bytes")).agg(F.sum("bytes")).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df
