"""DuckDB inside Spark tasks: the rows of a partition go through one SQL statement, a few megabytes of text at a time."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one statement takes; a longer text is a statement's only row.
SLICE_BYTES = 4 << 20


def _crc32(texts: pa.ChunkedArray) -> pa.Array:
    return pa.array(np.fromiter(map(zlib.crc32, texts.cast(pa.binary()).to_pylist()), np.uint32, len(texts)))


@functools.cache
def connection() -> duckdb.DuckDBPyConnection:
    """One in-memory database for each Python worker: one thread, nothing on disk, with crc32(text) from zlib."""
    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1; SET temp_directory = ''; SET enable_progress_bar = false")
    con.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes of column each, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def ask(sql: str, rows: pa.RecordBatch, **others: pa.Table) -> pa.Table:
    """The rows of sql, which reads `batch`, and the others by their names."""
    con = connection()
    given = {"batch": pa.Table.from_batches([rows])} | others
    for name, t in given.items():
        con.register(name, t)
    try:
        found = con.sql(sql).to_arrow_table()
    finally:
        for name in given:
            con.unregister(name)
    return found


def numbered(rows: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """Some columns of rows under their given names, and `pos`, the number of the row."""
    picked = [rows.column(rows.schema.get_field_index(c)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(rows.num_rows)), *picked], ["pos", *columns])


def joined(rows: pa.RecordBatch, found: pa.Table, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """rows with the columns of found, which has a row for each in the same order, as given by its column `pos`."""
    if found.num_rows != rows.num_rows or not np.array_equal(found.column("pos").to_numpy(), np.arange(rows.num_rows)):
        raise RuntimeError("rows came back in another order or number")
    extra = [found.column(k).combine_chunks().cast(t) for k, t in enumerate(types.values(), start=1)]
    extra = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in extra]
    return pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, *types])


def with_columns(df: DataFrame, columns: dict[str, str]) -> T.StructType:
    """The schema of df with further columns, as DDL types by name; all may be null."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    for name, kind in columns.items():
        schema = schema.add(name, T._parse_datatype_string(kind))
    return schema
