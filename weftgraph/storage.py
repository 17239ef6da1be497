"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process where that is unset (local runs only)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"weftgraph-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


#: Folders of tables that this process made and has not deleted, by session.
_MADE: dict[str, set[str]] = {}
_KEPT: dict[tuple, str] = {}


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; ``release`` or ``clear`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_weft_path", None)
        if path:
            fs, p = _file(df.sparkSession, path)
            fs.delete(p, True)
            _MADE.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def made(spark: SparkSession) -> set[str]:
    """The tables of this session that are not deleted."""
    return set(_MADE.get(spark.sparkContext.applicationId, ()))


def clear(spark: SparkSession, keep: set[str] | None = None) -> int:
    """Delete the tables that this process made in the session's shared folder, but for ``keep``; call it once results are read. Gives their number."""
    paths = made(spark) - (keep or set())
    _MADE.get(spark.sparkContext.applicationId, set()).difference_update(paths)
    for path in paths:
        fs, p = _file(spark, path)
        fs.delete(p, True)
    return len(paths)


def kept(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make`` as a table that queries of this session share; made anew when a file of ``sources`` changes."""
    stamp = []
    for source in sources:
        fs, p = _file(spark, source)
        files = fs.listStatus(p)
        stamp.append((source, sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0), len(files)))
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, tuple(stamp))
    path = _KEPT.get(key)
    if path:
        fs, p = _file(spark, path)
        if fs.exists(p):
            return spark.read.parquet(path)
    out = materialize(make(), name)
    _KEPT[key] = out._weft_path
    return out
