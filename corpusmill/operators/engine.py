"""Search from question to ranked results, for many questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards
from . import index, lexical, ranking
from . import search as S


def assess(questions: DataFrame, text: str = "text", code: str = "") -> DataFrame:
    """questions in canonical form, with outcome: the guard that stops a question, or null."""
    out = questions.withColumn(text, guards.canonical_question(text)).withColumn("_form", guards.safety_form(text))
    short = F.when(F.length(text) < 3, "invalid_question")
    stopped = guards.outcome(text, F.size(guards.control_reasons("_form")) > 0, code)
    return out.withColumn("outcome", F.coalesce(short, stopped)).drop("_form")


def search(
    questions: DataFrame, chunks: DataFrame, mode: str = "hybrid", top_k: int = 10, sites=(), types=(), rerank: bool = True,
    code: str = "", key: str = "qid", text: str = "text", lexicon: lexical.Index | None = None,
) -> DataFrame:
    """key, outcome, mode_used, warning, rank, doc_id, score and its parts; a row without a rank for a question that has no results.

    questions: key, text and, for dense search, vector (of unit length). chunks: doc_id, text, sites, content_type,
    is_current, canonical, page, recommendation_id and, for dense search, embedding. Without vectors every mode falls back
    to bm25 (mode_used, and warning says so). Statistics are over all chunks, candidates the allowed ones; every candidate
    is scored, without a shared term or vector too. Refused questions never reach the join. Questions go to the chunks'
    tasks in blocks of index.BLOCK; the lexical hits and the candidates are stored. With a lexicon no hit is: each of its shards
    scores its own chunks and gives the best of them (operators.ranking).
    """
    if mode not in ("bm25", "dense", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    top_k = min(max(int(top_k), 1), 20)
    dense = mode != "bm25" and "embedding" in chunks.columns and "vector" in questions.columns
    used = mode if dense else "bm25"
    asked = assess(questions, text, code)
    open_ = asked.where("outcome is null").select(F.col(key).alias("query_id"), F.col(text).alias("question"), *(["vector"] if dense else []))
    may = S.allowed(chunks, sites, types)
    may = may.select("doc_id", "sites", "content_type", "is_current", "canonical", "page", "recommendation_id", *(["embedding"] if dense else []))
    if lexicon is None:
        top = S.search(may, open_, index.bm25(chunks, open_, qkey="query_id", qtext="question", among=may.select("doc_id")), used)
    else:
        top = ranking.best(lexicon, may, open_, used)
    if rerank:
        terms = S.salient_terms(open_, "query_id", "question", code)
        covered = S.coverage(top, chunks, terms) if lexicon is None else lexical.coverage(lexicon, top, terms)
        top = S.rerank(top, covered, top_k).withColumn("final", F.col("rerank_score"))
    else:
        top = top.withColumn("coverage", F.lit(None).cast("double")).withColumn("rank", F.col("first_rank")).where(F.col("rank") <= top_k).withColumn("final", F.col("score"))
    detail = [F.round("final", 6).alias("score"), F.round("base", 6).alias("base"), F.round("bm25", 6).alias("bm25"), F.round("adjustment", 6).alias("adjustment"), F.round("coverage", 6).alias("coverage"), "first_rank"]
    results = top.select(F.col("query_id").alias("_q"), "rank", "doc_id", *detail)
    out = asked.select(key, "outcome").join(results, F.col(key) == F.col("_q"), "left").drop("_q")
    named = F.coalesce("outcome", F.when(F.col("rank").isNull(), "no_results").otherwise("retrieval_results"))
    fell = F.lit(None if used == mode else f"{mode} search has no vectors: ranked by bm25").cast("string")
    shown = named == "retrieval_results"
    return out.withColumns({"outcome": named, "mode_used": F.when(shown, used), "warning": F.when(shown, fell)})
