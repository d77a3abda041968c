"""Hybrid search of many questions at once: fuse, boost, cohere, cut, rerank.

Pairs have query_id, doc_id and the chunk's attributes (sites, content_type, is_current, canonical, page,
recommendation_id) with bm25 (null where no term is shared) and cosine (null without a vector), and the columns of
read_questions. Every allowed chunk is a candidate, one without a shared term or without a vector too.

No pair is shuffled before the best are cut. The questions go to the chunks' tasks, where each pair is scored as if it
shared no term; the pairs that do (hits, a row each) are joined to their chunks and scored in full beside them. The lexical
part never lowers a score, so a pair's full row ranks before its other one, and the 2k best rows hold the k best pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense, guards
from ..functions import text as T
from ..functions import vectors
from ..functions import vocabulary as V
from ..store import stash
from .index import bounded, exploded, idf, in_blocks

R = 10  # digits that scores are rounded to before they rank: sums may differ in the last ones by order


def allowed(chunks: DataFrame, sites=(), types=()) -> DataFrame:
    """Chunks of any of the sites and of one of the types; an empty list is no filter."""
    if types:
        chunks = chunks.where(F.col("content_type").isin(list(types)))
    return chunks.where(F.arrays_overlap("sites", F.array(*map(F.lit, sites)))) if sites else chunks


def pairs(chunks: DataFrame, questions: DataFrame, hits: DataFrame, embedding: str = "embedding", vector: str = "vector") -> DataFrame:
    """Every question with every chunk, and those of hits (query_id, doc_id, bm25) once more with bm25.

    questions: a block (index.in_blocks), with the columns of read_questions. Without vectors on both sides cosine is null.
    """
    tops = hits.groupBy("query_id").agg(F.max("bm25").alias("top_bm25"))  # a row a question
    asked = F.broadcast(questions.join(F.broadcast(tops), "query_id", "left"))
    plain = chunks.crossJoin(asked).withColumn("bm25", F.lit(None).cast("double"))
    out = plain.unionByName(hits.join(chunks, "doc_id").join(asked, "query_id"))
    both = embedding in chunks.columns and vector in questions.columns
    return out.withColumn("cosine", vectors.dot(embedding, vector) if both else F.lit(None).cast("double")).drop(embedding, vector)


def fuse(candidates: DataFrame, mode: str = "hybrid") -> DataFrame:
    """Adds bm25_norm (by the question's best), dense and base."""
    out = candidates.withColumn("bm25_norm", F.when(F.col("top_bm25") > 0, F.coalesce("bm25", F.lit(0.0)) / F.col("top_bm25")).otherwise(0.0))
    out = out.withColumn("dense", F.when(F.col("cosine").isNotNull(), vectors.rescaled("cosine")).otherwise(0.0)).drop("top_bm25")
    base = {"bm25": F.col("bm25_norm"), "dense": F.col("dense"), "hybrid": V.BM25_WEIGHT * F.col("bm25_norm") + V.DENSE_WEIGHT * F.col("dense")}
    return out.withColumn("base", base[mode])


def best_pairs(rows: DataFrame, k: int, *order) -> DataFrame:
    """The k best pairs of each question in this order, each once, with their rank. Every task keeps 2k rows a question."""
    full = F.col("bm25").desc_nulls_last()
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, full))
    out = rows.withColumn("rank", near).where(F.col("rank") <= 2 * k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(full))).where(F.col("rank") == 1)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def read_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds what a question asks for: asked_evidence, asked_method, asked_sites, asked_ids, asked_types.

    Patterns are matched here, a time a question, and not on each of its candidates.
    """
    q = F.col(text)
    return questions.withColumns({
        "asked_evidence": q.rlike(V.EVIDENCE_TERMS),
        "asked_method": q.rlike(V.METHODOLOGY_TERMS),
        "asked_sites": guards.selected_sites(text),
        "asked_ids": F.array_distinct(F.regexp_extract_all(q, F.lit(V.RECOMMENDATION_ID), F.lit(0))),
        "asked_types": guards.intent_types(T.tokens(text)),
    })


def boost(fused: DataFrame) -> DataFrame:
    """Adds adjustment and score: authority by intent, id, currency and site. Needs the columns of read_questions."""
    authority = (
        F.when(F.col("asked_evidence"), F.when(F.col("content_type").isin(V.EVIDENCE_TYPES), V.EVIDENCE_BOOST).otherwise(0.0))
        .when(F.col("canonical"), V.CANONICAL_BOOST)
        .when(F.col("is_current"), V.CURRENT_BOOST)
        .otherwise(0.0)
    )
    exact = F.when(F.array_contains("asked_ids", F.col("recommendation_id")), V.EXACT_ID_BOOST).otherwise(0.0)
    method = F.when((F.col("content_type") == "methodology") & ~F.col("asked_method"), V.METHODOLOGY_PENALTY).otherwise(0.0)
    site = F.when(F.arrays_overlap("asked_sites", "sites"), V.SITE_BOOST).otherwise(0.0)
    out = fused.withColumn("adjustment", exact + authority + method + site)
    return out.withColumn("score", F.greatest(F.lit(0.0), F.col("base") + F.col("adjustment")))


def anchors(boosted: DataFrame) -> DataFrame:
    """query_id, anchor: each question's best canonical chunk with sites, as struct(s, k, sites); its filter reaches the scan."""
    key = F.struct(F.round("score", R).alias("s"), (-F.col("doc_id")).alias("k"), F.col("sites").alias("sites"))
    return boosted.where(F.col("canonical") & (F.size("sites") > 0)).groupBy("query_id").agg(F.max(key).alias("anchor"))


def with_anchor_sites(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds anchor_sites: the anchor's sites where a question names no site, asks for no evidence and its anchor is good enough."""
    open_ = ~F.col("asked_evidence") & (F.size("asked_sites") == 0)
    out = rows.join(F.broadcast(found), "query_id", "left")  # a row a question of the block
    return out.withColumn("anchor_sites", F.when(open_ & (F.col("anchor.s") >= V.ANCHOR_LEAST), F.col("anchor.sites"))).drop("anchor")


def cohere(boosted: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Where a question names no site and asks for no evidence, its best canonical chunk's sites pull the others.

    found: the anchors, if they are stored; else canonical chunks are scored a second time for them.
    """
    out = with_anchor_sites(boosted, anchors(boosted) if found is None else found)
    pull = F.when(F.col("anchor_sites").isNull(), 0.0).when(F.arrays_overlap("sites", "anchor_sites"), V.ANCHOR_BOOST).when(F.size("sites") > 0, V.ANCHOR_PENALTY).otherwise(0.0)
    return out.withColumn("adjustment", F.col("adjustment") + pull).withColumn("score", F.greatest(F.lit(0.0), F.col("score") + pull))


def first_stage(scored: DataFrame, k: int = V.CANDIDATES) -> DataFrame:
    """first_rank up to k: by score, current before others, by page, then by id."""
    best = best_pairs(scored, k, F.round("score", R).desc(), F.col("is_current").desc(), F.col("page"), F.col("doc_id"))
    return best.withColumnRenamed("rank", "first_rank")


def search(chunks: DataFrame, questions: DataFrame, hits: DataFrame, mode: str = "hybrid", k: int = V.CANDIDATES, coherent: bool = True, vector: str = "vector") -> DataFrame:
    """The first stage whole, stored: the k best pairs of each question (query_id, question, vector) with first_rank.

    hits are stored first: they are read for the questions' best, for the anchors and for the ranks.
    """
    hits = stash(hits, "hits")

    def run(block):
        read = stash(read_questions(block).drop("question"), "questions-read")
        own = hits.join(F.broadcast(block.select("query_id")), "query_id", "left_semi")
        scored = boost(fuse(pairs(chunks, read, own, vector=vector), mode))
        found = stash(anchors(scored), "anchors") if coherent else None
        if coherent:
            scored = cohere(scored, found)
        # only numbers are ranked; what else a pair has comes back to the few that are left
        narrow = scored.select("query_id", "doc_id", "bm25", "bm25_norm", "dense", "base", "adjustment", "score", "is_current", "page")
        top = stash(first_stage(narrow, k), "ranked").join(F.broadcast(read.drop(vector)), "query_id")
        whole = chunks.drop("embedding", "is_current", "page").join(F.broadcast(top), "doc_id")
        return stash(with_anchor_sites(whole, found) if coherent else whole, "candidates")

    return in_blocks(questions, "query_id", run)


def coverage(candidates: DataFrame, chunks: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """query_id, doc_id, coverage: the share of a question's salient terms, weighed by IDF, that a candidate holds.

    terms: query_id, term. IDFs are over all chunks, by partial counts of a row a term and task; only the candidates' own
    terms are shuffled (candidates: a stored table of a few rows a question).
    """
    asked = bounded(terms.select("term").distinct())
    words = F.array_distinct(T.tokens(text))
    df = exploded(chunks, [], words).join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(n)).select("query_id", "term", idf(F.col("n"), F.col("df")).alias("idf"))
    weighed = stash(weighed, "salient")
    whole = weighed.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    found = candidates.select("query_id", "doc_id")
    some = chunks.select("doc_id", text).join(bounded(found.select("doc_id").distinct()), "doc_id", "left_semi")
    own = exploded(some, ["doc_id"], words).join(asked, "term", "left_semi")
    held = found.join(own, "doc_id").join(weighed, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("idf").alias("held"))
    return held.join(whole, "query_id").select("query_id", "doc_id", (F.col("held") / F.col("whole")).alias("coverage"))


def salient_terms(questions: DataFrame, key: str, text: str, code: str = "") -> DataFrame:
    terms = questions.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(T.tokens(text))).alias("term"))
    return terms.where(~F.col("term").isin([*V.RERANK_STOPWORDS, *([code] if code else [])]) & ~F.col("term").rlike("^[0-9]+$"))


def rerank(candidates: DataFrame, covered: DataFrame, k: int = 10) -> DataFrame:
    """rank up to k by the second stage's score; ties keep the first stage's order."""
    out = candidates.join(covered, ["query_id", "doc_id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    top = F.max("score").over(Window.partitionBy("query_id"))
    intent = F.when(F.array_contains("asked_types", F.col("content_type")), V.INTENT_BOOST).otherwise(0.0)
    asked = F.size("asked_sites") > 0
    site = F.when(asked & F.arrays_overlap("asked_sites", "sites"), V.RERANK_SITE_BOOST).when(asked & (F.size("sites") > 0), V.RERANK_SITE_PENALTY).otherwise(0.0)
    score = V.RERANK_SCORE_WEIGHT * F.col("score") / F.when(top > 0, top).otherwise(1.0) + V.RERANK_COVERAGE_WEIGHT * F.col("coverage") + intent + site
    out = out.withColumn("rerank_score", score)
    order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", R).desc(), F.col("is_current").desc(), "page", "first_rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(rows: DataFrame, questions: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, cosine, rank: the k rows of largest inner product for each question (exact, all rows).

    Questions (key, vector) go to every task in blocks, so rows aren't shuffled. A task takes batches of rows as matrices
    (functions.dense), one product a batch, and keeps k rows a question; only these meet for the ranks. Products are
    rounded to 6 digits before they rank, ties go to the smaller id. Null vectors and keys take no part; a vector of another
    length than the questions' fails.
    """
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")

    def run(block):
        asked = dense.Questions.of(block)
        best = own.mapInArrow(asked.best(k), f"query_id {asked.kind}, vec_id long, cosine double")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return in_blocks(questions.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("query_vector")), "query_id", run)


def dense_range(rows: DataFrame, questions: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, best, worst, rows: the largest and smallest inner product of each question with all rows, and their number."""
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def run(block):
        asked = dense.Questions.of(block)
        each = own.mapInArrow(asked.extent(), f"query_id {asked.kind}, best double, worst double, rows long")
        return each.groupBy("query_id").agg(F.max("best").alias("best"), F.min("worst").alias("worst"), F.sum("rows").alias("rows"))

    return in_blocks(questions.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("query_vector")), "query_id", run)
