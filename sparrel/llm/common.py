"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import findable

#: Rows that a Python function turns into objects at once; bounds a worker's memory whatever Arrow's batch size is.
SLICE_ROWS = 256
#: Rows and bytes that Spark hands to a Python function at once, at most (a longer row goes alone).
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8192", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return findable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparrel-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_KEPT: dict[str, Callable[[], object]] = {}


def keeps(name: str, clear: Callable[[], object]) -> None:
    """Says that this process keeps something between tasks, and how to let go of it."""
    _KEPT[name] = clear


def only(name: str) -> None:
    """Let go of what others keep in this process: workers are used again, stage after stage of other operators."""
    for other, clear in _KEPT.items():
        if other != name:
            clear()


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system (workers are used again, stage after stage)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of a bounded number of rows and bytes, so that long texts don't add up in a worker."""
    for key, value in BATCHES.items():
        findable(df.sparkSession).conf.set(key, value)

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return df.mapInArrow(fresh, schema)


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """mapInArrow of a function from a slice of a batch to a list of columns, in the schema's order."""
    out = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in _struct(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows(batch), out, strict=True)], schema=out)

    return map_arrow(df, run, schema)


def filtered(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of df that a function of their texts keeps, with all columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return map_arrow(df, run, df.schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}


def _struct(schema: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema)


def fold_of(doc_id, folds: int = 5):
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]
