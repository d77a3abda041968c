"""Sources and sinks of an evidence corpus: JSON lines, CSV, pages, indexes with manifests, checkpoints.

Every reader takes a schema and fails on rows that don't fit it; nothing is inferred. Writers use Spark's commit protocol,
so a failed job leaves no partial output.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import index


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a malformed row fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Quoted CSV with a header, all columns strings, line breaks within quotes; a byte order mark is no part of a name."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=True).csv(path)


def write_csv(df: DataFrame, path: str, blanks: list[str] = ()) -> None:
    """CSV with a header; `blanks` are columns left for people to fill in."""
    df.select("*", *[F.lit(None).cast("string").alias(b) for b in blanks]).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def read_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that is one JSON document."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """document, page, text of the PDF files in a folder; needs a PDF library on the executors (`pypdf`)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                for i, page in enumerate(PdfReader(io.BytesIO(content)).pages, start=1):
                    yield pd.DataFrame({"document": [name], "page": [i], "text": [page.extract_text() or ""]})

    return files.mapInPandas(pages, "document string, page int, text string")


def read_npy(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """row, embedding of a file of vectors in NumPy's format (two dimensions, numbers only); read in pieces of so many rows.

    A file is one array, so a task reads a file; many files are read side by side, and row counts from 0 in each (file).
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        import io

        import numpy as np
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim != 2:
                    raise ValueError(f"{name} holds no rows of vectors")
                for lo in range(0, len(x), rows):
                    part = x[lo : lo + rows].astype(float)
                    yield pd.DataFrame({"file": name, "row": np.arange(lo, lo + len(part)), "embedding": list(part)})

    return found.mapInPandas(run, "file string, row long, embedding array<double>")


def corpus_digest(chunks: DataFrame, key: str = "chunk_id", text: str = "text"):
    """One row: a digest of a corpus that doesn't depend on the order of its rows (the sums of its rows' hash halves, hashed)."""
    h = F.sha2(F.concat_ws("\n", F.col(key).cast("string"), F.col(text)), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    return chunks.agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c")).select(
        F.col("n").alias("rows"), F.sha2(F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit("0")) for x in ("n", "a", "b", "c")]), 256).alias("digest")
    )


def write_index(vectors: DataFrame, chunks: DataFrame, path: str, model: str) -> None:
    """The vectors, and a manifest that ties them to their corpus and model."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    stats = index.manifest(vectors).crossJoin(corpus_digest(chunks)).withColumn("model", F.lit(model))  # one row each
    write_report(stats.drop("rows").select("*", F.lit("float").alias("dtype")), f"{path}/manifest")


def open_index(spark: SparkSession, path: str, chunks: DataFrame, model: str) -> DataFrame:
    """The vectors of an index; fails if the corpus or the model have changed since, or a vector is no unit vector."""
    stored = spark.read.json(f"{path}/manifest").first()
    now = corpus_digest(chunks).first()
    if stored is None or stored.digest != now.digest:
        raise ValueError("the index does not match the corpus; build it again")
    if stored.model != model:
        raise ValueError("the index was made with another model")
    if stored.not_unit or stored.not_finite or stored.other_length:
        raise ValueError("the index holds invalid or unnormalised vectors")
    return spark.read.parquet(f"{path}/vectors")


def chained_digest(files: DataFrame, order: str = "ord", name: str = "path", content: str = "digest") -> DataFrame:
    """One row: the digest of files' names and digests, joined in their listed order (a list of files, not of their rows)."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.col(name), F.col(content)).alias("x"))))
    return files.agg(F.sha2(F.array_join(F.transform(listed, lambda f: f["x"]), ""), 256).alias("digest"))


def write_snapshot(rows: DataFrame, path: str, at: int) -> None:
    """What a run has so far, as a numbered snapshot beside the earlier ones; the commit protocol makes each whole or absent."""
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={at:06d}")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the latest snapshot, none before the first."""
    found = read_checkpoint(spark, path, f"{schema}, snapshot int")
    last = found.agg(F.max("snapshot")).first()[0]
    return found.where(F.col("snapshot") == F.lit(last)).drop("snapshot")


def drop_snapshots(spark: SparkSession, path: str) -> None:
    """Deletes the snapshots, once the run's result is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def copy_file(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a file to a stable name, on any file system; nothing is done if they are one. Returns whether it was copied."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    a, b = path(source), path(target)
    fa, fb = a.getFileSystem(conf), b.getFileSystem(conf)
    if fa.makeQualified(a).equals(fb.makeQualified(b)):
        return False
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, True, conf)


def read_reports(spark: SparkSession, required: str, optional: dict[str, str]) -> DataFrame:
    """One row: a report, and beside it others by name, each a struct; null where its file is missing. A missing first fails."""
    out = spark.read.options(multiLine=True, mode="FAILFAST").json(required).select(F.struct("*").alias("report"))
    for name, path in optional.items():
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            one = spark.read.options(multiLine=True, mode="FAILFAST").json(path).limit(1).select(F.struct("*").alias(name))
            out = out.crossJoin(F.broadcast(one))  # one row
        else:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def append_checkpoint(done: DataFrame, path: str) -> None:
    """Finished work, added to what earlier runs have finished."""
    done.write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished work of all runs, empty before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_attempt(done: DataFrame, path: str, run: str) -> bool:
    """Finished work of a run, which counts once: returns whether this attempt is the run's.

    The rows go to a folder of the attempt's own, and a file named by the run then says which attempt counts; it is made only
    where there is none. An attempt that fails before that is never read, and one that is tried again after it changes
    nothing. run: letters, digits, `-`, `_` and `.`; runs are ordered by name.
    """
    spark, attempt = done.sparkSession, uuid.uuid4().hex
    if not re.fullmatch(r"[\w-][\w.-]*", run, re.ASCII) or run.startswith("_"):
        raise ValueError(f"not a name of a run: {run!r}")
    if run in _commits(spark, path):
        return False
    done.write.parquet(f"{path}/attempts/attempt={attempt}")
    fs, mark = _on_file_system(spark, f"{path}/commits/{run}")
    try:
        out = fs.create(mark, run in _marks(spark, path) and run not in _commits(spark, path))  # over a mark that was never filled
        out.write(bytearray(f"{run} {attempt}\n", "ascii"))
        out.close()
    except Py4JJavaError as failed:
        if "AlreadyExists" not in failed.java_exception.getClass().getName():
            raise
    if _commits(spark, path).get(run) == attempt:
        return True
    fs, folder = _on_file_system(spark, f"{path}/attempts/attempt={attempt}")
    fs.delete(folder, True)
    return False


def read_attempts(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of all runs' attempts that count, one of each key: the first run's, if several did the same work.

    Of rows of one run with the same key the one of least digest stays. Empty before the first run.
    """
    commits = _commits(spark, path)  # a line a run
    if not commits:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/attempts/attempt={a}" for a in commits.values()]
    rows = spark.read.schema(f"{schema}, attempt string").option("basePath", f"{path}/attempts").parquet(*folders)
    names = [c for c in rows.columns if c != "attempt"]
    runs = spark.createDataFrame([(a, r) for r, a in commits.items()], "attempt string, _run string")
    whole = F.struct(*names)
    first = F.min_by(whole.alias("_row"), F.struct("_run", F.sha2(F.to_json(whole), 256)))
    return rows.join(F.broadcast(runs), "attempt").groupBy(*keys).agg(first.alias("_row")).select("_row.*")


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Deletes what failed attempts left, and returns how many; not while a run is being appended."""
    kept, (fs, folder) = set(_commits(spark, path).values()), _on_file_system(spark, f"{path}/attempts")
    found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    left = [p for p in found if p.getName().removeprefix("attempt=") not in kept]
    return sum(fs.delete(p, True) for p in left)


def _on_file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _marks(spark: SparkSession, path: str) -> set[str]:
    fs, folder = _on_file_system(spark, f"{path}/commits")
    return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def _commits(spark: SparkSession, path: str) -> dict[str, str]:
    """The attempt that counts of each run, by the runs' names in order."""
    if not _marks(spark, path):
        return {}
    lines = spark.read.text(f"{path}/commits").where("value <> ''").collect()  # a line a run
    return dict(sorted(line.value.split(" ") for line in lines))
