"""Models as sources: anything that embeds or answers text, run batch by batch on the executors.

A model is a factory without arguments, called once a task, that gives a function of a list of texts. A call that fails
is repeated with growing waits, then fails its task, which Spark runs again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType


def retried(call: Callable, tries: int = 3, longest: float = 8.0) -> Callable:
    def run(batch):
        for i in range(tries):
            try:
                return call(batch)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(min(2.0**i, longest))

    return run


def _mapped(rows: DataFrame, text: str, out: str, kind, model: Callable[[], Callable], batch: int, shape: Callable) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]):
        call = retried(model())
        for frame in frames:
            parts = [shape(call(frame[text].iloc[i : i + batch].tolist())) for i in range(0, len(frame), batch)]
            yield frame.assign(**{out: [x for p in parts for x in p]})

    return rows.mapInPandas(run, StructType([*rows.schema, StructField(out, kind)]))


def embed(rows: DataFrame, model: Callable[[], Callable], text: str = "text", out: str = "embedding", prefix: str = "", batch: int = 32) -> DataFrame:
    """rows with unit vectors of a text; prefix tells documents and questions apart to models that need it."""

    def shape(vectors):
        v = np.asarray(vectors, float)
        return list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))

    with_prefix = lambda: (lambda f: lambda texts: f([prefix + (t or "") for t in texts]))(model())
    return _mapped(rows, text, out, ArrayType(DoubleType()), with_prefix, batch, shape)


def generate(rows: DataFrame, model: Callable[[], Callable], prompt: str = "prompt", out: str = "answer", batch: int = 8) -> DataFrame:
    """rows with a model's answer to a prompt. Filter first: only rows that pass the guards should cost a call."""
    return _mapped(rows, prompt, out, StringType(), model, batch, list)


def repaired(rows: DataFrame, model: Callable[[], Callable], needs, prompt: str = "repair_prompt", out: str = "answer") -> DataFrame:
    """One bounded second pass over the rows that need it; the others stay as they are."""
    again = generate(rows.where(needs), model, prompt, "_new")
    fixed = again.drop(out).withColumnRenamed("_new", out)
    return rows.where(~needs).unionByName(fixed.select(*rows.columns))


def judge(tasks: DataFrame, model: Callable[[], Callable], prompt: str = "prompt", schema: str = "schema", batch: int = 8) -> DataFrame:
    """tasks with label, reason and claim_ids of a judge's answers; what isn't a JSON object fails that task alone.

    A judge is a factory of a function from a list of (prompt, schema) to a list of answers, code fences and all. The
    rows that fail have a null label; `judging.valid` drops them, and `judging.pending` asks for them again.
    """
    pairs = tasks.withColumn("_asked", F.to_json(F.struct(F.col(prompt).alias("prompt"), F.col(schema).alias("schema"))))
    asked = lambda: (lambda f: lambda rows: f([tuple(json.loads(r).values()) for r in rows]))(model())
    out = _mapped(pairs, "_asked", "_answer", StringType(), asked, batch, list)
    answer = F.from_json(unfenced("_answer"), "label string, reason string, claim_ids array<string>")
    return out.withColumn("_read", answer).select(*tasks.columns, "_read.*")


def unfenced(answer):
    """An answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def healthy(spark: SparkSession, model: Callable[[], Callable], probe: str = "ping") -> bool:
    """Whether a model answers from an executor; its failure is an answer too, not an error."""

    def run(frames):
        for frame in frames:
            try:
                ok = len(model()(frame["probe"].tolist())) == len(frame)
            except Exception:
                ok = False
            yield pd.DataFrame({"ok": [ok]})

    return spark.createDataFrame([(probe,)], "probe string").mapInPandas(run, "ok boolean").first().ok
