"""Footers of Parquet files as tables. Files are listed by Spark and read through it, so any store will do."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

FILE = "path string, num_rows long, num_row_groups int, file_size long"
COLUMN = "path string, name string, type string, compression string, has_bloom boolean, bytes_per_value double"


def _files(spark: SparkSession, path: str) -> DataFrame:
    # a footer is at the end, but the binary source gives whole files; this is for index files of a few MB
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length", "content")


def _footers(batches, rows_of, names):
    for batch in batches:
        out = []
        for path, size, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += rows_of(path, size, pq.ParquetFile(io.BytesIO(content)).metadata)
        yield pa.RecordBatch.from_pylist(out, schema=names)


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per file: path, num_rows, num_row_groups, file_size."""
    schema = pa.schema([("path", pa.string()), ("num_rows", pa.int64()), ("num_row_groups", pa.int32()), ("file_size", pa.int64())])

    def rows(p, size, m):
        return [{"path": p, "num_rows": m.num_rows, "num_row_groups": m.num_row_groups, "file_size": size}]

    return _files(spark, path).mapInArrow(lambda b: _footers(b, rows, schema), FILE)


def column_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Per file and column, of the first row group: name, type, compression, has_bloom, bytes_per_value."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("type", pa.string()), ("compression", pa.string()), ("has_bloom", pa.bool_()), ("bytes_per_value", pa.float64())])

    def rows(p, size, m):
        if not m.num_row_groups:
            return []
        group = m.row_group(0)
        columns = [group.column(i) for i in range(group.num_columns)]
        bloom = lambda c: getattr(c, "bloom_filter_offset", None) is not None
        return [{"path": p, "name": c.path_in_schema, "type": c.physical_type, "compression": c.compression, "has_bloom": bloom(c), "bytes_per_value": c.total_compressed_size / max(1, c.num_values)} for c in columns]

    return _files(spark, path).mapInArrow(lambda b: _footers(b, rows, schema), COLUMN)
