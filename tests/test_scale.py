"""Operators that number, pack, match and search at scale, against brute force on small rows."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, index, reconcile, windows
from corpusmill.operators import search as S


def packed(sizes, target, most):
    """The rule in a loop: close before `most` would be passed, or once `target` is reached; a separator counts 1."""
    out, held, n = [], [], 0
    for i, s in enumerate(sizes):
        if held and n + 1 + s > most:
            out.append(held)
            held, n = [], 0
        n += s + (1 if held else 0)
        held = [*held, i]
        if n >= target:
            out.append(held)
            held, n = [], 0
    return [*out, held] if held else out


def test_packing_is_the_loop(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0, 1, 5, 30, 60, 69, 70]) for _ in range(rng.randint(0, 40))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, sizes array<int>")
    got = {r.id: [list(range(p.start, p.start + p.n)) for p in r.p] for r in frame.select("id", T.packed("sizes", 55, 70).alias("p")).collect()}
    assert got == {i: packed(s, 55, 70) for i, s in rows}


def test_packing_many_units_takes_linear_time(spark):
    import time

    frame = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: (i % 40).cast("int")).alias("sizes"))
    began = time.time()
    assert frame.select(F.size(T.packed("sizes"))).first()[0] > 8000
    assert time.time() - began < 30


def test_wrapped_lines_are_the_loop(spark):
    def loop(text):
        out, cur = [], ""
        for line in text.split("\n"):
            x = re.sub("[ \t]+", " ", line).strip(" ")
            if not x or x[0] in "•-":
                out, cur = out + ([cur] if cur else []), x
            else:
                cur = x if not cur else cur + x if cur.endswith("-") else cur + " " + x
        return "\n".join(out + ([cur] if cur else []))

    rng = random.Random(5)
    rows = [("\n".join(rng.choice(["a b", "", " \t", "• x", "-y", "long-", "z  z", "end."]) for _ in range(rng.randint(0, 12))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string").select("t", T.join_wrapped("t").alias("j")).collect()
    assert all(r.j == loop(r.t) for r in got)


def test_numbers_over_ranges_are_those_of_a_window(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, rng.random()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, id int, v double").repartition(7)
    got = {(r.k, r.id): r.number for r in windows.numbered(frame, ["k"], ["v", "id"]).collect()}
    want = frame.withColumn("number", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    assert got == {(r.k, r.id): r.number for r in want.collect()}
    ranks = windows.at_ranks(frame.where("k is not null"), ["k"], "v", {"p90": lambda n: F.ceil(n * 0.9), "first": lambda n: F.lit(1)})
    for r in ranks.collect():
        own = sorted(v for k, _, v in rows if k == r.k)
        assert (r.p90, r.first) == (own[-(-len(own) * 9 // 10) - 1], own[0])
    assert windows.numbered(frame.where("false"), ["k"], ["v"]).count() == 0


def test_ranges_in_blocks_of_intervals(spark):
    rng = random.Random(9)
    intervals = [(i, lo := rng.randint(0, 90), lo + rng.randint(0, 20)) for i in range(30)]
    values = spark.range(100).withColumn("v", F.col("id"))
    got = {(r.id, r.i) for r in windows.within(values, "v", spark.createDataFrame(intervals, "i int, lo int, hi int"), "lo", "hi", block=7).collect()}
    assert got == {(v, i) for v in range(100) for i, lo, hi in intervals if lo <= v <= hi}


def test_best_matches_by_prefix_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{chr(97 + i)}" for i in range(12)]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 9)))
    left, right = [(i, text()) for i in range(40)], [(i, text()) for i in range(150)]
    a, b = (spark.createDataFrame(x, "id int, text string") for x in (left, right))

    def brute(k, least):
        out = set()
        for i, x in left:
            scores = []
            for j, y in right:
                p, q = set(x.split()), set(y.split())
                if p & q and (score := len(p & q) / len(p | q)) >= least:
                    scores.append((-round(score, 10), j))
            out |= {(i, j, n) for n, (_, j) in enumerate(sorted(scores)[:k], 1)}
        return out

    for k, least in ((1, 0.0), (3, 0.0), (1, 0.32), (2, 0.6)):
        got = reconcile.best_by_terms(a, b, k, least).collect()
        assert {(r.left_id, r.right_id, r["rank"]) for r in got} == brute(k, least), (k, least)


def counted(text):
    return len(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower()))


RECORDS = "record_id string, text string, source_type string, content_type string, retrieval_eligible boolean"


def test_chunk_builder_rules(spark):
    long_ = " ".join(f"Sentence number {i} is here." for i in range(60))
    rows = [
        ("whole", long_, "current_guideline", "recommendation", True), ("cut", long_, "full_guideline", "evidence", True), ("gone", long_, "full_guideline", "evidence", False),
        ("unknown", long_, "full_guideline", "evidence", None), ("table", "a b c. D e f\n" * 50, "full_guideline", "evidence_table", True), ("short", "one two", None, None, True),
        ("word", "x " * 300, "full_guideline", "evidence", True), ("null", None, "full_guideline", "evidence", True),
    ]
    out = chunking.chunks(spark.createDataFrame(rows, RECORDS), target=55, most=70).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.chunk_index):
        by.setdefault(r.record_id, []).append(r)
    assert set(by) == {"whole", "cut", "table", "short", "word", "null"}
    assert len(by["whole"]) == 1 and by["whole"][0].token_count == counted(long_) and len(by["null"]) == 1
    for name in ("cut", "table", "word"):
        assert len(by[name]) > 1 and all(r.token_count <= 70 and r.token_count == counted(r.text) for r in by[name])
        assert [r.chunk_id for r in by[name]] == [f"{name}_c{i:02d}" for i in range(1, len(by[name]) + 1)] and by[name][0].chunk_count == len(by[name])
    assert "\n".join(r.text for r in by["cut"]).split() == long_.split()
    assert all(x == "a b c. D e f" for r in by["table"] for x in r.text.split("\n"))
    assert [r.record_id for r in chunking.oversize(spark.createDataFrame(out), 70).collect()] == ["whole"]


def test_chunks_by_a_byte_pair_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    own, counter = chunking._encoding(path, tokenizers.PATTERN), chunking.BpeCounter(path, tokenizers.PATTERN)
    text = " ".join(f"Incomprehensibilities of sentence {i} abound." for i in range(40)) + " " + "unbroken" * 60
    rows = spark.createDataFrame([("r", text, "full_guideline", "evidence", True)], RECORDS)
    out = chunking.chunks(rows, counter, 55, 70).collect()
    assert len(out) > 5 and all(r.token_count == len(own.encode_ordinary(r.text)) for r in out)
    assert sum(r.token_count > 75 for r in out) == 0


CHUNKS = "doc_id int, text string, sites array<string>, content_type string, is_current boolean, canonical boolean, page int, recommendation_id string, embedding array<double>"


def world(spark, n=60, m=11):
    rng = random.Random(8)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    text = lambda: " ".join(rng.choice(["cough", "blood", "scan", "weight", "lump", "pain"]) for _ in range(rng.randint(0, 6)))
    kinds = ["recommendation", "evidence", "methodology"]
    chunks = [(i, text(), [rng.choice(["lung", "renal"])] if i % 3 else [], kinds[i % 3], i % 2 == 0, i % 6 == 0, i % 5, f"1.1.{i}", None if i % 4 == 1 else unit(vector())) for i in range(n)]
    questions = [(i, text() + (" why" if i % 3 == 0 else ""), None if i % 5 == 1 else unit(vector())) for i in range(m)]
    return spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(questions, "query_id int, question string, vector array<double>")


def brute_search(spark, chunks, questions, hits, mode, k):
    """All pairs at once, each with its hit, ranked by a window."""
    pairs = chunks.crossJoin(S.read_questions(questions)).join(hits, ["query_id", "doc_id"], "left")
    top = hits.groupBy("query_id").agg(F.max("bm25").alias("top_bm25"))
    dot = F.aggregate(F.zip_with("embedding", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = S.cohere(S.boost(S.fuse(pairs.join(top, "query_id", "left").withColumn("cosine", dot), mode)))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 10).desc(), F.desc("is_current"), "page", "doc_id")
    return scored.withColumn("first_rank", F.row_number().over(order)).where(F.col("first_rank") <= k)


@pytest.mark.parametrize("mode", ["bm25", "dense", "hybrid"])
def test_search_is_that_of_all_pairs(spark, monkeypatch, mode):
    chunks, questions = world(spark)
    hits = index.bm25(chunks, questions, qkey="query_id", qtext="question")
    show = lambda df: {(r.query_id, r.doc_id, r.first_rank, round(r.score, 8)) for r in df.collect()}
    want = show(brute_search(spark, chunks, questions, hits, mode, 7))
    assert len(want) == 11 * 7 and show(S.search(chunks, questions, hits, mode, 7)) == want
    monkeypatch.setattr(index, "BLOCK", 3)  # several blocks of questions
    assert show(S.search(chunks, questions, hits, mode, 7)) == want


def test_no_pair_is_shuffled_before_the_cut(spark):
    chunks, questions = world(spark)
    hits = index.bm25(chunks, questions, qkey="query_id", qtext="question")
    hits = spark.createDataFrame(hits.collect(), hits.schema)  # stored, as by S.search
    plan = S.first_stage(S.boost(S.fuse(S.pairs(chunks, S.read_questions(questions), hits))))._jdf.queryExecution().executedPlan().toString()
    above = {}
    for line in plan.split("\n"):
        depth = len(re.match(r"[\s:+\-|]*", line)[0])
        above = {d: x for d, x in above.items() if d < depth} | {depth: line}
        if "BroadcastNestedLoopJoin" in line or "CartesianProduct" in line:
            assert "CartesianProduct" not in line
            nodes = [x for _, x in sorted(above.items(), reverse=True)]
            first = next(i for i, x in enumerate(nodes) if "Exchange" in x)
            assert any("WindowGroupLimit" in x for x in nodes[:first])
