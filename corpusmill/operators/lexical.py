"""A stored lexical index: built once, opened by every search, with exact top k by skipping.

A shard is what a task reads on, up to SHARD_DOCS documents or SHARD_BYTES of tokens, so texts are neither shuffled nor sorted
for the index. A shard's rows are one per term, the documents (their places in the shard) and how often each holds it, and
one under the empty term, the shard's keys and lengths. The postings lie in BUCKETS folders by the term's hash, so a search
reads the folders of its terms and no text. terms has df and cf, corpus one row: n, tokens.

Search: the asked terms' rows meet by shard, a shard in one task and at most its own postings; questions go to the tasks
in blocks. Within a shard a question's terms are added from the largest bound (weight times the block's largest impact)
down. Sums so far bound the scores from below: once the k-th best of them is above all that the terms left could add, no
further document can enter (MaxScore), and only the few whose sum and remaining bound reach it are looked up in the
postings left. A first part of the shards gives each question a bound for all others. Exact for every k.

Defined cases: a document without tokens is counted and never found; a null text has no tokens and doesn't count for
the mean length, a null key is kept;
rows that share a key are documents of their own; a question without known terms finds nothing; an empty table gives an
empty index. Stale indexes aren't opened: a source whose size, file count or time has changed is indexed anew.
"""

from __future__ import annotations

import itertools
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..store import CODEC, shared_dir, stash
from .index import idf, question_terms

SHARD_DOCS, SHARD_BYTES = 2_048, 16 << 20
BUCKETS = 32
#: One shard in so many gives the bounds for the others.
LEAD = 8
#: Scores that differ by less may tie once they are rounded.
SLACK = 1e-5
#: Terms of all questions that are sent to the tasks at once (about).
MOST_TERMS = 400_000


@dataclass(frozen=True)
class Index:
    """Where an index lies, and how many shards it would have if all were full (tasks' last ones aren't)."""

    spark: SparkSession
    path: str
    shards: int

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", "term string, shard long, docs array<long>, tfs array<int>, bucket int")

    @property
    def terms(self) -> DataFrame:
        """term, df, cf."""
        return self._table("terms", "term string, df long, cf long")

    @property
    def corpus(self) -> DataFrame:
        """n, tokens, texts (that aren't null; the mean length is theirs): one row."""
        return self._table("corpus", "n long, tokens long, texts long")

    @property
    def documents(self) -> DataFrame:
        """doc_id, dl of every document (null for a null text)."""
        both = self.postings.where(F.col("bucket") == -1).select(F.explode(F.arrays_zip("docs", "tfs")).alias("d"))
        return both.select(F.col("d.docs").alias("doc_id"), F.col("d.tfs").cast("long").alias("dl"))

    @property
    def places(self) -> DataFrame:
        """doc_id, shard of every document."""
        own = self.postings.where(F.col("bucket") == -1)
        return own.select(F.explode("docs").alias("doc_id"), "shard")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, a long, and others) with shard, a time a shard that holds the document; those of none are left out."""
        at = self.places.select(F.col("doc_id").alias("_held"), "shard")
        return rows.join(at, F.col("doc_id").eqNullSafe(F.col("_held"))).drop("_held")

    def stats(self) -> DataFrame:
        """term, df, cf, idf."""
        return self.terms.crossJoin(F.broadcast(self.corpus)).select("term", "df", "cf", idf(F.col("n"), F.col("df")).alias("idf"))

    def rows_of(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms (a column term), from their folders alone; terms must be small enough to send to all tasks."""
        buckets = [r[0] for r in terms.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
        return self.postings.where(F.col("bucket").isin(buckets)).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _posted(shard: int, keys: pa.Array, tokens: pa.ListArray) -> pa.Table:
    """A shard's rows from its documents' tokens."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy()
    words = tokens.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    code, tf = np.unique(words.indices.to_numpy().astype(np.int64) * max(len(sizes), 1) + doc, return_counts=True)
    term, doc = code // max(len(sizes), 1), code % max(len(sizes), 1)
    ends = np.searchsorted(term, np.arange(len(words.dictionary) + 1)).astype(np.int32)
    lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values).cast(kind))
    own = np.array([0, len(sizes)], np.int32)
    keys = pa.ListArray.from_arrays(pa.array(own), keys.cast(pa.int64()))
    parts = [
        pa.table([pa.array([""]), keys, lists(own, tokens.value_lengths(), pa.int32())], names=["term", "docs", "tfs"]),
        pa.table([words.dictionary, lists(ends, doc, pa.int64()), lists(ends, tf, pa.int32())], names=["term", "docs", "tfs"]),
    ]
    whole = pa.concat_tables(parts)
    return whole.add_column(1, "shard", pa.array(np.full(len(whole), shard, np.int64)))


def _sharded(docs: int, size: int):
    """A function for mapInArrow over (doc_id, tokens): the rows of a task's shards, each of so many documents or bytes at most."""

    def run(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held, n, bytes_ = [], 0, 0

        def done():
            both = [pa.concat_arrays([h[i] for h in held]) for i in (0, 1)]
            return _posted(next(numbers), *both).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            keys, tokens = batch.columns
            ends = np.r_[0, np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())]
            lengths = np.r_[0, np.cumsum(pc.binary_length(tokens.flatten()).to_numpy(zero_copy_only=False))][ends]
            at = 0
            while at < len(batch):
                room = int(np.searchsorted(lengths, lengths[at] + max(size - bytes_, 0), "right")) - 1
                to = min(max(room, at + (not held)), at + docs - n, len(batch))
                if to > at:
                    held.append((keys.slice(at, to - at), tokens.slice(at, to - at)))
                    n, bytes_ = n + to - at, bytes_ + int(lengths[to] - lengths[at])
                    at = to
                if at < len(batch) or n >= docs:
                    yield from done()
                    held, n, bytes_ = [], 0, 0
        if held:
            yield from done()

    return run


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of docs (key: a long) to path. Texts are tokenized once, in the tasks that read them; nothing is shuffled but term counts."""
    spark = docs.sparkSession
    read = docs.select(F.col(key).cast("long").alias("doc_id"), T.tokens(text).alias("tokens"))
    rows = read.mapInArrow(_sharded(SHARD_DOCS, SHARD_BYTES), "term string, shard long, docs array<long>, tfs array<int>")
    rows = rows.withColumn("bucket", F.when(F.col("term") == "", -1).otherwise(_bucket(F.col("term"))))
    rows.write.partitionBy("bucket").option("compression", CODEC).parquet(f"{path}/postings")
    index = Index(spark, path, 0)
    n = index.postings.where("bucket = -1").agg(F.sum(F.size("docs"))).first()[0] or 0
    index = Index(spark, path, max(math.ceil(n / SHARD_DOCS), 1))
    sums = index.postings.select("bucket", "term", F.size("docs").cast("long").alias("df"), F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("cf"), F.size(F.array_compact("tfs")).cast("long").alias("texts"))
    sums.where("bucket >= 0").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).write.option("compression", CODEC).parquet(f"{path}/terms")
    whole = sums.where("bucket = -1").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("cf"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"))
    whole.write.parquet(f"{path}/corpus")
    return index


def opened(spark: SparkSession, source: str, read, key: str = "doc_id", text: str = "text") -> Index:
    """The index of the table at source, built by this application's first call; read() gives its documents."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held, status = files.getContentSummary(at), files.getFileStatus(at)
    stamp = (source, key, text, held.getLength(), held.getFileCount(), status.getModificationTime())
    known = spark.sparkContext.__dict__.setdefault("_corpusmill_indexes", {})
    if stamp in known:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{known[stamp].path}/corpus/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return known[stamp]
    path = "/".join([shared_dir(spark), "corpusmill", spark.sparkContext.applicationId, f"lexical-{uuid.uuid4().hex}"])
    known[stamp] = build(read(), path, key, text)
    return known[stamp]


def _places(keys: pa.Array, wanted: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.is_in(keys, value_set=wanted).to_numpy(zero_copy_only=False))


class Block:
    """A shard's postings of the asked terms, as arrays: a term's postings are those of its range, by place."""

    def __init__(self, table: pa.Table, mean: float, k1: float, b: float, among: pa.Array | None = None):
        terms = table.column("term").to_pylist()
        own = terms.index("")
        lists = [table.column(c).combine_chunks() for c in ("docs", "tfs")]
        sizes = lists[0].value_lengths().to_numpy()
        ends = np.r_[0, np.cumsum(sizes)]
        docs, tfs = (x.flatten().fill_null(0).to_numpy(zero_copy_only=False) for x in lists)
        self.keys = lists[0][own].values
        self.n = int(sizes[own])
        length = tfs[ends[own] : ends[own + 1]].astype(np.float64)
        inside = np.ones(len(docs), bool)
        inside[ends[own] : ends[own + 1]] = False
        if among is not None:
            allowed = np.zeros(self.n, bool)
            allowed[_places(self.keys, among)] = True
            inside[inside] = allowed[docs[inside]]
        order = [i for i in range(len(terms)) if i != own]
        self.number = {terms[i]: j for j, i in enumerate(order)}
        of = np.repeat(np.arange(len(terms)), sizes)
        of = np.where(of > own, of - 1, of)[inside]
        docs, tf = docs[inside], tfs[inside].astype(np.float64)
        self.docs = docs.astype(np.int64)
        self.impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[self.docs] / mean)) if mean else np.zeros(len(tf))
        self.code = of * max(self.n, 1) + self.docs  # in order, as each term's places are
        self.ends = np.searchsorted(of, np.arange(len(order) + 1))
        self.most = np.zeros(len(order))
        np.maximum.at(self.most, of, self.impact)

    def _added(self, sums: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        lo, n = self.ends[terms], self.ends[terms + 1] - self.ends[terms]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        sums += np.bincount(self.docs[at], np.repeat(weights, n) * self.impact[at], minlength=self.n)

    def every(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that hold one of the terms."""
        sums = np.zeros(self.n)
        self._added(sums, terms, weights)
        at = np.flatnonzero(sums)
        return at, sums[at]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = 0.0, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that may be of the k best, given that k others score `least`; none else is scored."""
        bound = weights * self.most[terms]
        by = np.argsort(-bound, kind="stable")
        terms, weights, bound = terms[by], weights[by], bound[by]
        left = np.r_[np.cumsum(bound[::-1])[::-1], 0.0]
        sums, done, step = np.zeros(self.n), 0, 4
        while done < len(terms) and left[done] >= least - slack:
            more = min(done + step, len(terms))
            self._added(sums, terms[done:more], weights[done:more])
            done, step = more, 2 * step
            if self.n >= k:
                least = max(least, float(np.partition(sums, self.n - k)[self.n - k]))
        at = np.flatnonzero((sums > 0) & (sums + left[done] >= least - slack))
        score = sums[at]
        for lo in range(done, len(terms), 64):  # look the documents left up, and let go of those that fall behind
            some = terms[lo : lo + 64]
            code = some[:, None] * max(self.n, 1) + at[None, :]
            place = np.minimum(np.searchsorted(self.code, code), max(len(self.code) - 1, 0))
            hit = self.code[place] == code if len(self.code) else np.zeros(code.shape, bool)
            score = score + (weights[lo : lo + 64, None] * np.where(hit, self.impact[place], 0.0)).sum(0)
            keep = score + left[min(lo + 64, len(terms))] >= least - slack
            at, score = at[keep], score[keep]
        return at, score


def _weights(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, term, weight: of the questions' terms that the index knows."""
    known = index.terms.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    weighed = terms.join(F.broadcast(known), "term").crossJoin(F.broadcast(index.corpus))
    return weighed.select("query_id", "term", (idf(F.col("n"), F.col("df")) * F.col("qw")).alias("weight"))


def _run(index: Index, weights: DataFrame, score, kind: str, k1: float, b: float, shards=None, among: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score: what score(block, i, terms, weights) finds in each shard for each question i of a block of them."""
    spark = index.spark
    weights = stash(weights, "asked-terms")
    got = weights.orderBy("query_id", "term").toArrow()  # a block's terms
    queries, which = np.unique(np.array(got.column(0).to_pylist(), object), return_inverse=True) if len(got) else (np.empty(0, object), np.empty(0, np.int64))
    words = got.column(1).to_pylist()
    shared = spark.sparkContext.broadcast((queries.tolist(), which, words, got.column(2).to_numpy()))
    _, tokens, texts = index.corpus.first()
    mean = tokens / texts if texts else 0.0
    rows = index.rows_of(weights)
    own = index.postings.where(F.col("bucket") == -1)
    rows = rows.unionByName(own).select("shard", "term", "docs", "tfs")
    rows = rows if shards is None else shards(rows)
    out = f"query_id {kind}, doc_id long, score double"

    def found_in(table: pa.Table, among: pa.Array | None) -> pa.Table:
        asked, which, words, weight = shared.value
        block = Block(table, mean, k1, b, among)
        at = np.array([block.number.get(w, -1) for w in words], np.int64)
        there = np.flatnonzero(at >= 0)
        cuts = np.searchsorted(which[there], np.arange(len(asked) + 1))
        ids, docs, scores = [], [], []
        for i in range(len(asked)):
            own = there[cuts[i] : cuts[i + 1]]
            if len(own):
                found, s = score(block, asked[i], at[own], weight[own])
                ids += [asked[i]] * len(found)
                docs.append(found)
                scores.append(s)
        docs = block.keys.take(pa.array(np.concatenate([np.empty(0, np.int64), *docs])))
        return pa.table([pa.array(ids, _ARROW[kind]), docs, pa.array(np.concatenate([np.empty(0), *scores]))], names=["query_id", "doc_id", "score"])

    def alone(table: pa.Table) -> pa.Table:
        return found_in(table, None)

    if among is None:
        return rows.groupBy("shard").applyInArrow(alone, out)
    may = index.placed(among.select(F.col("doc_id").cast("long").alias("doc_id")))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table([pa.array([], _ARROW[kind]), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "doc_id", "score"])
        return found_in(left, right.column("doc_id").combine_chunks())

    return rows.groupBy("shard").cogroup(may.groupBy("shard")).applyInArrow(both, out)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _blocks(terms: DataFrame, run) -> DataFrame:
    """run for blocks of questions with about MOST_TERMS terms (query_id, term), joined."""
    terms = stash(terms.where(F.col("query_id").isNotNull()), "terms")
    blocks, out = math.ceil(terms.count() / MOST_TERMS) or 1, None
    for i in range(blocks):
        some = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        got = run(some)
        out = got if out is None else out.unionByName(got)
    return out


def hits(index: Index, questions: DataFrame, qkey: str = "item_id", qtext: str = "text", k1: float = V.K1, b: float = V.B, among: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, bm25 of every pair that shares a term; among: the only documents (doc_id) to score."""
    kind = questions.schema[qkey].dataType.simpleString()

    def run(terms):
        return _run(index, _weights(index, terms), lambda b_, i, t, w: b_.every(t, w), kind, k1, b, among=among).withColumnRenamed("score", "bm25")

    return _blocks(question_terms(questions, qkey, qtext), run)


def topk(index: Index, questions: DataFrame, k: int = 10, qkey: str = "item_id", qtext: str = "text", k1: float = V.K1, b: float = V.B, among: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, bm25: of each question all pairs that may be of its k best (and few others), scored exactly."""
    kind = questions.schema[qkey].dataType.simpleString()

    def run(terms):
        weights = stash(_weights(index, terms), "weights")
        ask = lambda least, where: _run(index, weights, lambda b_, i, t, w: b_.best(t, w, k, least.value.get(i, 0.0) if least else 0.0), kind, k1, b, where, among)
        if index.shards < 2 * LEAD:
            return ask(None, None)
        lead = F.pmod(F.xxhash64("shard"), F.lit(LEAD)) == 0
        first = stash(ask(None, lambda rows: rows.where(lead)), "leads")
        nth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        # k scores a question of a block
        least = {r[0]: r[1] for r in nth.where(F.col("n") >= k).select("query_id", F.element_at("s", k)).collect()}
        return first.unionByName(ask(index.spark.sparkContext.broadcast(least), lambda rows: rows.where(~lead)))

    return _blocks(question_terms(questions, qkey, qtext), run).withColumnRenamed("score", "bm25")


def coverage(index: Index, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, doc_id, coverage: the share of a question's salient terms, weighed by IDF, that a candidate holds.

    candidates: query_id, doc_id (a few a question); terms: query_id, term. Only the candidates' shards are looked at, and
    of their postings those of the questions' terms.
    """

    def run(block):
        weights = stash(_weights(index, block.withColumn("qw", F.lit(1))), "salient")
        whole = weights.groupBy("query_id").agg(F.sum("weight").alias("whole"))
        found = stash(candidates.select("query_id", F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(whole.select("query_id")), "query_id", "left_semi"), "covered")
        kind = found.schema["query_id"].dataType.simpleString()
        asked = found.toArrow()  # a few rows a question of a block
        pairs: dict = {}
        for q, d in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist()):
            pairs.setdefault(q, []).append(d)
        shared = index.spark.sparkContext.broadcast({q: pa.array(d, pa.int64()) for q, d in pairs.items()})

        def held(block_, i, t, w):
            wanted = shared.value.get(i)
            if wanted is None:
                return np.empty(0, np.int64), np.empty(0)
            at = _places(block_.keys, wanted)
            code = t[:, None] * max(block_.n, 1) + at[None, :]
            place = np.minimum(np.searchsorted(block_.code, code), max(len(block_.code) - 1, 0))
            return at, (w[:, None] * (block_.code[place] == code)).sum(0)

        few = F.broadcast(found.select("doc_id").distinct())  # a few rows a question of a block
        mine = stash(index.places.join(few, "doc_id", "left_semi").select("shard").distinct(), "near")
        rows = _run(index, weights, held, kind, V.K1, V.B, lambda rows: rows.join(F.broadcast(mine), "shard", "left_semi"))
        return rows.join(F.broadcast(whole), "query_id").select("query_id", "doc_id", (F.col("score") / F.col("whole")).alias("coverage"))

    return _blocks(terms, run)
