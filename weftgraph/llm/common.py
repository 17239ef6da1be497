"""Shared plumbing: shared-folder tables, size checks and Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: A word, in every operator of this package that counts words.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side may be broadcast; its count is checked each time.
BROADCAST_ROWS = 200_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_weft_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within the bound; else leave the join to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` (for a file scan: bytes on storage)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, target_bytes: int, least: int = 1) -> int:
    """Number of partitions of about ``target_bytes`` of storage each; the session's own number where the size is unknown."""
    size = estimated_bytes(df)
    if size >= 2**62:  # Catalyst's stand-in for a size that it does not know
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(1_000_000, -(-size // target_bytes)))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Map ``{column: list}`` batches in Python workers, Arrow both ways.

    ``fn`` gets an iterator of batches as Python lists and yields batches
    likewise; columns follow ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists() -> Iterator[dict]:
            for b in batches:
                for part in _slices(b):
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in fn(lists()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


#: Rows of a batch are handed to Python code in runs of about this many bytes.
SLICE_BYTES = 2_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that its Python copy stays small, at whole rows."""
    n = batch.num_rows
    if n:
        step = max(1, min(n, int(n * SLICE_BYTES / max(1, batch.get_total_buffer_size()))))
        for k in range(0, n, step):
            yield batch.slice(k, step)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
