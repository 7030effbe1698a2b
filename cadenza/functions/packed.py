"""Vectors of doubles as bytes: little-endian, one after another. Bytes are written, read and sent whole, lists number by number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bits of the NaN that stands for null.
NA = 0x7FF80000000007A2


def numbers(a: pa.Array) -> np.ndarray:
    """An Arrow array's numbers as doubles; a null is the NaN of bits ``NA``."""
    out = a.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if a.null_count:
        out = out.copy()
        out.view(np.int64)[a.is_null().to_numpy(zero_copy_only=False)] = NA
    return out


def pack(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values one after another as an array of bytes; ``ends`` has 0 and where each row's values end."""
    offsets = (8 * ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, "<f8"))])


def _values(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed values one after another, 0 and where each row's end, and which are null."""
    ends = np.zeros(len(a) + 1, np.int64)
    ends[1:] = np.cumsum(pc.binary_length(a).fill_null(0).to_numpy(zero_copy_only=False)) // 8
    first = int(np.frombuffer(a.buffers()[1], np.int32)[a.offset]) if ends[-1] else 0
    values = np.frombuffer(a.buffers()[2], "<f8", int(ends[-1]), first) if ends[-1] else np.zeros(0)
    return values, ends, values.view(np.int64) == NA


def unpack(a: pa.Array) -> pa.Array:
    """Packed values as an array of lists."""
    values, ends, null = _values(a)
    mask = a.is_null() if a.null_count else None
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, mask=null if null.any() else None), mask=mask)


def unpacked(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its packed column as an array of doubles."""
    if not isinstance(df.schema[name].dataType, T.BinaryType):
        return df
    at = df.columns.index(name)
    schema = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) if f.name == name else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([unpack(c) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, schema)


def summed(df: DataFrame, name: str, size: str, total: str) -> DataFrame:
    """``df`` with its packed column replaced by how many values a row has and their sum, null if one of them is."""
    own = [c for c in df.columns if c != name]
    schema = df.select(*own, F.lit(None).cast("int").alias(size), F.lit(None).cast("double").alias(total)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(len(own))
            values, ends, null = _values(a)
            out, some = np.zeros(len(a)), np.flatnonzero(np.diff(ends))
            lost = missing = a.is_null().to_numpy(zero_copy_only=False)
            if len(some):
                out[some] = np.add.reduceat(values, ends[some])
                if null.any():
                    lost = missing.copy()
                    lost[some] |= np.logical_or.reduceat(null, ends[some])
            added = [pa.array(np.diff(ends).astype(np.int32), mask=missing), pa.array(out, mask=lost)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *added], names=schema.names)

    return df.select(*own, name).mapInArrow(run, schema)
