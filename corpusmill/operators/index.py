"""The lexical index as tables, and the dense index's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..functions import vocabulary as V

#: Terms of all questions up to which they are broadcast.
BROADCAST_TERMS = 500_000


def bounded(small: DataFrame, rows: int = BROADCAST_TERMS) -> DataFrame:
    """A broadcast hint if small has at most so many rows; else a shuffled join, which AQE splits where keys are hot."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


#: Questions that are sent to all tasks at once, with their vectors.
BLOCK = 2_000


def in_blocks(questions: DataFrame, key: str | list[str], run, size: int | None = None) -> DataFrame:
    """run(block) for blocks of at most about `size` questions, joined: each block is sent to all tasks (run may broadcast it).

    So a question set of any size is answered with memory of a stated bound; more questions take more scans.
    """
    n, size = questions.count(), size or BLOCK
    if n <= size:
        return run(questions)
    blocks, out = -(-2 * n // size), None
    for i in range(blocks):
        got = run(questions.where(F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(blocks)) == i))
        out = got if out is None else out.unionByName(got)
    return out


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, dl of every document."""
    return docs.select(F.col(key).alias("doc_id"), T.tokens(text).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))


def exploded(rows: DataFrame, keys: list, array, name: str = "term") -> DataFrame:
    """keys and each element of an array, none for empty ones.

    A plain explode makes Catalyst test the array's size first, which tokenizes every text twice, and below any exchange.
    """
    return rows.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, term, tf."""
    return exploded(tokenized(docs, key, text), ["doc_id"], "tokens").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, cf, idf over all documents. A document sends a term once: df and cf are partial sums by term alone."""
    per = postings(docs, key, text)
    n = docs.agg(F.count("*").alias("n"))
    stats = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return stats.crossJoin(F.broadcast(n)).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))


def question_terms(questions: DataFrame, key: str, text: str) -> DataFrame:
    """query_id, term, qw: a question's terms without its stopwords, counted up to two."""
    terms = exploded(questions.withColumn("query_id", F.col(key)), ["query_id"], T.tokens(text))
    return terms.where(~F.col("term").isin(V.QUERY_STOPWORDS)).groupBy("query_id", "term").agg(F.least(F.count("*"), F.lit(2)).alias("qw"))


def bm25(docs: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", qkey: str = "item_id", qtext: str = "text", k1: float = V.K1, b: float = V.B, among: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, bm25 of every pair that shares a term; among: the only documents (doc_id) to score.

    Only the questions' terms are exploded from the documents, so postings of other terms are never shuffled; the corpus
    statistics (count, mean length) are one row.
    """
    terms = question_terms(questions, qkey, qtext)
    # one check for all: the other small sides have a row a term, or a row a term and question, at most
    small = F.broadcast if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else (lambda df: df)
    docs = tokenized(docs, key, text)
    corpus = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    held = exploded(docs, ["doc_id", "dl"], "tokens").join(small(terms.select("term").distinct()), "term", "left_semi")
    # dealt by document once: counting its terms and summing its scores need no further shuffle
    tf = held.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(small(df), "term").crossJoin(F.broadcast(corpus))
    hits = (tf if among is None else tf.join(among, "doc_id", "left_semi")).join(small(weighed), "term")
    size = k1 * (1 - b + b * F.col("dl") / F.col("mean"))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + size) * F.col("qw")
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("bm25"))


def manifest(index: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: rows, dimensions, and how many vectors are no unit vectors, not finite or of another length."""
    n = F.size(vector)
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = index.agg(F.max(n).alias("dimensions"))
    rows = index.crossJoin(F.broadcast(d))
    return rows.agg(
        F.count("*").alias("rows"),
        F.max("dimensions").cast("long").alias("dimensions"),
        F.count_if(F.abs(vectors.norm(vector) - 1) > 1e-4).alias("not_unit"),
        F.count_if(~finite).alias("not_finite"),
        F.count_if(n != F.col("dimensions")).alias("other_length"),
    )
