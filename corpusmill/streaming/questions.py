"""Streams of questions and of telemetry, with the batch operators' expressions. Extensions: the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from ..functions import text as T
from ..functions import vocabulary as V


def guarded(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds outcome, null where the question goes on to retrieval; stateless."""
    return questions.withColumn("outcome", guards.outcome(text))


def scored(questions: DataFrame, postings: DataFrame, idf: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """key, doc_id and weight of each shared term: a stream-static join of the terms of questions that pass the guards."""
    terms = guarded(questions, text).where("outcome is null").select(key, F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    terms = terms.where(~F.col("term").isin(V.QUERY_STOPWORDS))
    return terms.join(idf, "term").join(postings, "term").select(key, "doc_id", "term", (F.col("idf") * F.col("tf")).alias("weight"))


def telemetry(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts, errors and the 95th percentile of values in tumbling windows; rows later than `late` are dropped."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    out = per.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile_approx("value", 0.95).alias("p95"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "errors", "p95")
