"""The stored lexical index and dense blocks against plain scoring."""

import random

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from corpusmill.functions import dense
from corpusmill.operators import engine, index, lexical, search
from corpusmill.plans import registry


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "...")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    docs = spark.createDataFrame(texts(1500), "doc_id long, text string").repartition(5).cache()
    asked = docs.where("doc_id % 50 = 0 and text is not null").select(F.col("doc_id").alias("item_id"), "text")
    asked = asked.unionByName(spark.createDataFrame([(-1, "unknown zzz"), (-2, ""), (-3, None), (None, "w1 w2")], "item_id long, text string")).cache()
    sizes = lexical.SHARD_DOCS, lexical.LEAD
    lexical.SHARD_DOCS, lexical.LEAD = 64, 4
    yield docs, asked, lexical.build(docs, str(tmp_path_factory.mktemp("lexical") / "i"))
    lexical.SHARD_DOCS, lexical.LEAD = sizes


def pairs(df):
    return {(r.query_id, r.doc_id): r.bm25 for r in df.collect()}


def test_hits_equal_plain_scores(made):
    docs, asked, lex = made
    plain = pairs(index.bm25(docs, asked.where("item_id is not null")))
    got = pairs(lexical.hits(lex, asked))
    assert lex.shards == 24 and got.keys() == plain.keys()
    assert all(got[p] == pytest.approx(plain[p]) for p in plain)


def test_statistics(made):
    docs, _, lex = made
    assert spark_rows(lex.stats()) == spark_rows(index.term_stats(docs))
    assert spark_rows(lex.documents) == spark_rows(index.tokenized(docs).select("doc_id", "dl"))


@pytest.mark.parametrize("k,b,k1", [(1, 0.75, 1.5), (10, 0.75, 1.5), (10, 0.0, 0.9), (2000, 1.0, 2.0)])
def test_topk_is_exact(made, k, b, k1):
    docs, asked, lex = made
    order = lambda scored: {q: sorted((-round(s, 6), d) for (p, d), s in scored.items() if p == q)[:k] for q in {p for p, _ in scored}}
    plain = pairs(index.bm25(docs, asked.where("item_id is not null"), k1=k1, b=b))
    assert order(pairs(lexical.topk(lex, asked, k, k1=k1, b=b))) == order(plain)


def test_filter_and_blocks(made, monkeypatch):
    docs, asked, lex = made
    may = docs.where("doc_id % 3 = 0").select("doc_id")
    plain = pairs(index.bm25(docs, asked.where("item_id is not null"), among=may))
    monkeypatch.setattr(lexical, "MOST_TERMS", 100)
    got = pairs(lexical.hits(lex, asked, among=may))
    assert got.keys() == plain.keys() and all(got[p] == pytest.approx(plain[p]) for p in plain)
    best = pairs(lexical.topk(lex, asked, 3, among=may))
    for q in {q for q, _ in plain}:
        first = sorted((-round(s, 6), d) for (p, d), s in plain.items() if p == q)[:3]
        assert first == sorted((-round(s, 6), d) for (p, d), s in best.items() if p == q)[:3]


def test_few_pairs_are_scored(spark, made):
    """Whole texts as questions: of the pairs that share a term under a twentieth come out of the shards scored to the end."""
    docs, asked, lex = made
    shared = lexical.hits(lex, asked).count()
    assert lexical.topk(lex, asked, 1).count() < 0.05 * shared


def test_coverage_equals_plain(made):
    docs, asked, lex = made
    terms = search.salient_terms(asked.where("item_id is not null and text is not null"), "item_id", "text")
    some = lexical.topk(lex, asked, 5).select("query_id", "doc_id")
    plain = {(r.query_id, r.doc_id): r.coverage for r in search.coverage(some, docs, terms).collect()}
    got = {(r.query_id, r.doc_id): r.coverage for r in lexical.coverage(lex, some, terms).collect() if r.coverage}
    assert got.keys() == plain.keys() and all(got[p] == pytest.approx(plain[p]) for p in plain)


def test_plans_read_only_the_terms_folders(spark, made, capsys):
    _, asked, lex = made
    rows = lex.rows_of(spark.createDataFrame([("w1",)], "term string"))
    rows.explain("formatted")
    filters = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PartitionFilters")]
    assert len(filters) == 1 and "(bucket#" in filters[0] and rows.select("bucket").distinct().count() == 1
    best = lexical.topk(lex, asked, 3)
    best.explain("formatted")
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_index_is_built_once_and_anew_for_new_data(spark, tmp_path):
    source = str(tmp_path / "docs.parquet")
    spark.createDataFrame(texts(20), "doc_id long, text string").write.parquet(source)
    calls = []
    read = lambda: calls.append(1) or spark.read.parquet(source)
    first = lexical.opened(spark, source, read)
    assert lexical.opened(spark, source, read) is first and len(calls) == 1
    spark.createDataFrame(texts(5, 2), "doc_id long, text string").write.mode("append").parquet(source)
    assert lexical.opened(spark, source, read).corpus.first().n == 23 + 8 and len(calls) == 2


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    lex = lexical.build(docs, str(tmp_path / "e"))
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.topk(lex, asked).collect() == [] and lexical.hits(lex, asked).collect() == [] and lex.documents.collect() == []


def test_engine_with_and_without_index(spark, tmp_path):
    from test_engine import CHUNKS, QUESTIONS, SCHEMA

    questions = spark.createDataFrame(QUESTIONS, "qid string, text string, vector array<double>")
    chunks = spark.createDataFrame(CHUNKS, SCHEMA)
    lex = lexical.build(chunks, str(tmp_path / "c"))
    for more in ({}, {"mode": "bm25"}, {"sites": ["lung"]}, {"rerank": False, "types": ["recommendation"]}):
        assert spark_rows(engine.search(questions, chunks, lexicon=lex, **more)) == spark_rows(engine.search(questions, chunks, **more))


@pytest.mark.parametrize("cells", [7, 4_000_000])
def test_dense_blocks(spark, monkeypatch, cells):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 3)
    x[100:130] = x[5]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(300, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(dense, "CELLS", cells)
    got = {}
    for r in search.dense_topk(df, df.where("vec_id % 50 = 0"), 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.cosine))
    for q in range(0, 300, 50):
        score = np.round(x @ x[q], 6)
        best = sorted(range(300), key=lambda i: (-score[i], i))[:12]
        assert sorted(got[q]) == [(n + 1, i, pytest.approx(score[i], abs=2e-6)) for n, i in enumerate(best)]
    spans = {r.query_id: (r.best, r.worst, r.rows) for r in search.dense_range(df, df.where("vec_id % 50 = 0")).collect()}
    assert all(spans[q] == (pytest.approx((x @ x[q]).max()), pytest.approx((x @ x[q]).min()), 300) for q in spans) and len(spans) == 6
    odd = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="8 elements"):
        search.dense_topk(odd, df.where("vec_id = 50")).collect()


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_filtered", "term_stats", "doc_lengths", "hybrid_topk", "rerank_topk", "dense_topk", "dense_rescaled"])
def test_queries_at_a_larger_scale(spark, name):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(registry.queries()[name](spark, sf)) == duck_rows(registry.oracle_sql()[name], sf)


def test_an_index_is_built_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    """Shards are cut where the texts are read: by documents, by bytes, and every document stands in one of them."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", 3_000)
    docs = spark.createDataFrame([(i, f"w{i % 7} " * (i % 50) if i % 11 else None) for i in range(400)], "doc_id long, text string").repartition(3)
    lex = lexical.build(docs, str(tmp_path / "s"))
    assert sorted(r.doc_id for r in lex.places.collect()) == list(range(400))
    own = lex.postings.where("bucket = -1").selectExpr("aggregate(tfs, 0, (a, x) -> a + coalesce(x, 0)) AS words", "size(docs) AS n").collect()
    assert len(own) > 6 and all(r.words * 2 <= 3_000 or r.n == 1 for r in own)
    plain = {r.doc_id: r.dl for r in index.tokenized(docs).collect()}
    assert {r.doc_id: r.dl for r in lex.documents.collect()} == {i: (None if n is None or n < 0 else n) for i, n in plain.items()}
