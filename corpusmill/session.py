"""Session settings that the engine's plans are written for."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches. On a cluster the submitter's settings hold."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, whether or not it is installed there; once a context.

    Spark's file server hands the archive to every executor, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_corpusmill_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="corpusmill-ship-"), "corpusmill_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpusmill_shipped = True


def shipped(query):
    """The query, which ships the package first."""

    @functools.wraps(query)
    def run(spark, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
