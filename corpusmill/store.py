"""Tables stored between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: zstd compresses in buffers that are freed with the writer; snappy's direct buffers wait for the collector.
CODEC = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, since
    a folder of one machine would be missing on the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark.sparkContext, "_corpusmill_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext._corpusmill_dir = made
    return made


_scope: ContextVar[tuple[str, ...]] = ContextVar("corpusmill_scope", default=())


def stash_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    scope = _scope.get()[: -1 if outer else None]
    return "/".join([shared_dir(spark), "corpusmill", spark.sparkContext.applicationId, *scope, f"{name}-{uuid.uuid4().hex}"])


def stash(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors.

    outer: beside the scratch that is open, so that it outlives it.
    """
    path = stash_path(df.sparkSession, name, outer)
    df.write.option("compression", CODEC).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


@contextmanager
def scratch(spark: SparkSession, name: str):
    """Tables that are stored within are deleted at its end, but for those stored with `outer`."""
    token = _scope.set((*_scope.get(), f"{name}-{uuid.uuid4().hex}"))
    try:
        yield
    finally:
        path = "/".join([shared_dir(spark), "corpusmill", spark.sparkContext.applicationId, *_scope.get()])
        _scope.reset(token)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*stored: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; other frames are left alone."""
    for df in stored:
        if path := getattr(df, "_corpusmill_path", None):
            _delete(df.sparkSession, path)


def clear_stash(spark: SparkSession) -> None:
    """Deletes what this application stored; call it once its results are written."""
    _delete(spark, f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}")


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be none of the columns."""
    while name in columns:
        name = "_" + name
    return name
