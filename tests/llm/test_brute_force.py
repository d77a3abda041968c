"""Learned operators against plain versions of their parts, and rows that clash, repeat or are long."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from test_operators import QUERIES, Union, _flat, code_length, held, rows, words

from corpusmill.llm import ann, bpe, common, langid, mixing, quality, rules, simhash, toxicity
from corpusmill.llm.common import fold_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, data):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in data], DOCS)


# mixing


def crowded():
    """Null ids, ids that texts share, and whole repeats, each hundreds of rows of a source."""
    text = lambda i, n: " ".join(f"w{i}" for _ in range(n))
    out = [(None, text(i, 4), "a") for i in range(900)] + [(None, "same words here now", "b")] * 900
    out += [(7, text(i, 5), "c") for i in range(900)] + [(8, "all of it twice", "d")] * 900 + [(None, None, "a"), (9, None, "b")]
    return out + [(1000 + i, text(i, 3), "abcd"[i % 4]) for i in range(400)]


@pytest.mark.parametrize("run", [100_000, 50])
def test_mix_is_near_its_targets_whatever_ids_repeat(spark, run, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing.with_draw, "__defaults__", (*mixing.with_draw.__defaults__[:-1], run))
    root = str(tmp_path)
    frame(spark, crowded()).repartition(5).write.parquet(f"{root}/documents.parquet")
    got = rows(spark, "op1_mixing", root)
    taken, target, sizes = Counter(), {}, Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        target[r.source] = r.target
    for s in "abcd":
        assert abs(taken[s] - target[s]) < 0.05 * sizes[s], s
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, rows(spark, "op1_mixing", root)), key=repr)
    out = mixing.mix(spark.read.parquet(f"{root}/documents.parquet")).withColumn("n", F.regexp_count("text", F.lit(r"\S+")))
    mixed = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if run > 900:  # the same draws: the query's counts are those of the mix
        assert mixed == {s: taken[s] for s in "abcd"}
        from compare import duck_rows, spark_rows

        from corpusmill.llm import registry

        for t in ("labels", "pages", "embeddings"):
            spark.range(1).write.parquet(f"{root}/{t}.parquet")
        assert spark_rows(QUERIES["op1_mixing"](spark, root)) == duck_rows(registry.oracle_sql()["op1_mixing"], _flat(spark, root, "edge"))


def test_mix_keeps_columns_with_its_own_names(spark):
    docs = frame(spark, crowded()[:50]).withColumns({"__draw": F.lit(1), "__of": F.lit(2), "__run": F.lit(3), "__id": F.lit(4)})
    out = mixing.mix(docs)
    assert out.select("__draw", "__of", "__run", "__id").distinct().collect() == [(1, 2, 3, 4)]


# filters in place and joins of few rows


def test_sieve_parts_rows_without_losing_any(spark):
    rows_ = spark.range(2000).withColumn("__word", F.lit(1))
    for n, top in ((1 << 20, 130), (64, 130), (1, 900)):  # beyond its size the filter lets everything pass to the join
        alone, rest = common.sieved(rows_, F.xxhash64("id"), spark.range(100, top), F.xxhash64("id"), n)
        a, b = ({r.id for r in x.collect()} for x in (alone, rest))
        assert a | b == set(range(2000)) and not a & b and b >= set(range(100, top)) and alone.columns == ["id", "__word"]
        assert n < 1 << 20 or len(b) == 30
    assert len(a) == 0


def test_near_dedup_of_repeats_and_shared_ids(spark, monkeypatch):
    body = " ".join(f"w{i}" for i in range(60))
    data = [(1, body, "a"), (1, body, "a"), (1, "else entirely one two three", "a"), (None, body, "a"), (2, body, "b"), (3, "other words of length five six", "b"), (None, "x", "a"), (None, "x", "a")]
    for n in (1 << 20, 1):
        monkeypatch.setattr(common.sieved, "__defaults__", (n,))
        got = Counter((r.doc_id, r.text) for r in simhash.near_dedup(frame(spark, data).withColumn("__hash", F.lit(0))).collect())
        assert got == Counter({(1, body): 1, (1, "else entirely one two three"): 1, (3, "other words of length five six"): 1, (None, "x"): 1})


def test_rules_keep_judges_rows_not_ids(spark):
    good, poor = "plain words that say something " * 6, "| ! " * 60
    data = [(1, " ".join(f"w{i}" for i in range(30)), "a"), (1, "too short", "a"), (None, "short too", "a"), (None, " ".join(f"v{i}" for i in range(30)), "b"), (2, good, "a"), (2, poor, "a")]
    docs = frame(spark, data).withColumn("__lost", F.lit(1))
    want = Counter((r[0], r[1]) for r in data if len(words(r[1])) >= 20 and 100 * repeats(r[1]) <= 30 * len(words(r[1])))
    assert Counter((r.doc_id, r.text) for r in rules.keep(docs, None).collect()) == want


def repeats(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_filters_keep_what_the_queries_keep(spark, edge):
    docs, labels = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id >= 100").dropDuplicates(["doc_id"])
    for keep, query, good in ((rules.keep, "op9_rules", lambda r: r.kept), (toxicity.drop_toxic, "op10_toxicity", lambda r: not r.predicted)):
        root = common.stash_path(spark, "test")
        docs.write.parquet(f"{root}/documents.parquet")
        labels.write.parquet(f"{root}/labels.parquet")
        got = {r.doc_id for r in keep(spark.read.parquet(f"{root}/documents.parquet"), labels).collect()}
        assert got == {r.doc_id for r in rows(spark, query, root) if good(r)} and 0 < len(got) < docs.count()


# samples


def test_labelled_sample_is_bounded_whole_and_stable(spark):
    docs = frame(spark, [(i % 500, f"text {i}", "a") for i in range(1500)] + [(None, "null", "a"), (600, None, "a"), (601, "x " * 90_000, "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(800)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    sample, counts = common.labelled_sample(docs, labels, "quality", 40)
    got = sample.collect()
    assert counts == {0: 250, 1: 251} and Counter(r["__label"] for r in got) == {0: 40, 1: 40} and len({r.doc_id for r in got}) == 80
    again, _ = common.labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 40)
    assert {(r.doc_id, r.text) for r in again.collect()} == {(r.doc_id, r.text) for r in got}
    whole, _ = common.labelled_sample(docs, labels, "quality", 1000)
    assert 601 in {r.doc_id for r in whole.collect()}  # long texts are chosen like any other


# quality


def plain_text_view(b):
    counts = Counter()
    for i in range(len(b) - 2):
        h = (b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32
        counts[h >> 22] += 1
    w = b.split()
    out = np.zeros(1027)
    if w:
        for k, n in counts.items():
            out[k] = 4 * math.sqrt(n / sum(counts.values()))
        out[1024:] = len(set(w)) / math.sqrt(len(w)) / 10, len(set(w)) / len(w), 4 * sum(x == y for x, y in zip(w, w[1:])) / len(w)
    return out


def test_quality_views(monkeypatch):
    probe = [b"", b" ", b"ab", b"one two two three", "née 漢字 née".encode() * 9, b"x" * 5000]
    want = [plain_text_view(b) for b in probe]
    assert np.allclose([quality.text_view(b) for b in probe], want, atol=1e-5)
    monkeypatch.setattr(quality, "STEP", 7)  # texts are counted piece by piece
    assert np.allclose([quality.text_view(b) for b in probe], want, atol=1e-5)


def test_quality_views_of_a_text_beyond_a_step():
    b = (b"alpha beta gamma delta " * 60_000)[: (1 << 20) + 77]
    h = Counter()
    grams = Counter(b[i : i + 3] for i in range(len(b) - 2))
    for g, n in grams.items():
        h[(g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32 >> 22] += n
    got = quality.text_view(b)
    assert len(b) > quality.STEP and all(got[k] == pytest.approx(4 * math.sqrt(n / sum(h.values())), rel=1e-5) for k, n in h.items())


def test_meta_view_by_hand():
    v = quality.meta_view(b"a b\n\nc", None, "s", 6)
    assert v[0] == 1 and v[quality.KINDS + 1 + xxhash.xxh32_intdigest("s") % (quality.KINDS - 1)] == 1
    assert v[2 * quality.KINDS :] == pytest.approx([math.log1p(6) / 5, 0, math.log1p(3) / 3, math.log1p(2) / 5, 1 / 3, 5 / 4 / 10])


def test_co_training_exchanges_sure_labels():
    """Each view alone sees one of two marks; labelled rows show one view the mark, and the pool carries it to the other."""
    rng = np.random.default_rng(2)

    def draw(n, informative):
        y = rng.integers(0, 2, n)
        x = [rng.normal(0, 1, (n, 4)) for _ in range(2)]
        for v in informative:
            x[v][:, 0] += 6 * y - 3
        return x, y

    (a, b), y = draw(60, [0])  # labelled: only the first view is informative
    (p, q), _ = draw(800, [0, 1])  # pool: both are
    (s, t), truth = draw(400, [0, 1])
    alone = quality.Linear(b, y, np.ones(60))
    first, second = quality.co_train((a, b), y, (p, q), np.ones(60), rounds=3, sure=50)
    right = lambda m, v: ((m.raw(v) > 0) == truth).mean()
    assert right(second, t) > 0.95 > right(alone, t) and right(first, s) > 0.95
    none = quality.co_train((a, b), y, (p[:0], q[:0]), np.ones(60))
    assert np.allclose(none[1].raw(t), alone.raw(t))


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 3))
    y = (x[:, 0] + rng.normal(0, 1, 200) > 0).astype(int)
    weight = rng.uniform(0.5, 2, 200)
    w = common.logistic(x, y, weight, 0.7)
    z = np.c_[x, np.ones(200)]
    slope = z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y)) + np.r_[0.7 * w[:3], 1e-3 * w[3]]
    assert np.abs(slope).max() < 1e-4


# toxicity


def test_toxicity_gains_by_direct_calls():
    ordinary = b"plain words " * 30
    toxic = b"\0 scum idiot \0" + ordinary
    scorer = toxicity.Scorer(toxic, ordinary)
    settings = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    size = lambda d, x: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(x))
    text = "Plain words first, then SCUM IDIOT words " * 7 + "é" * 300
    gains, w = [], text.encode().lower().split()
    lead = ordinary[-toxicity.LEAD :] + b" "
    for part in toxicity.windows(w):
        gains.append(size(ordinary, lead + part) - size(toxic, lead + part))
    gains.sort()
    want = [gains[-1], np.mean(gains[-3:]), np.mean(gains), math.log(len(gains)), *(math.log1p(sum(g >= x for g in gains)) for x in toxicity.GAINS)]
    assert scorer.features(text.encode()) == pytest.approx(want) and gains[-1] > 3
    assert scorer.features(b" ") == [0.0] * (4 + len(toxicity.GAINS))


def test_toxic_dictionary_is_the_plain_counts():
    bad, good = [{b"scumbag", b"the", f"w{i}".encode()} for i in range(6)], [{b"the", b"cat", f"w{i}".encode()} for i in range(20)]
    every = sorted(set().union(*bad, *good))
    rows_ = [np.array(sorted(every.index(w) for w in d), np.int32) for d in bad + good]
    toxic, ordinary = toxicity.dictionaries(every, rows_, np.arange(26) < 6, (4,), 5.0, 8.0)
    assert b"scumbag" in toxic and b"scumbag" not in ordinary and toxic.endswith(ordinary) and ordinary.endswith(b"the cat")
    for k in (b" scu", b"mbag"):
        seen = [sum(any(k in b" " + w + b" " for w in d) for d in side) for side in (bad, good)]
        assert seen == [6, 0] and toxicity.g2(6, 0, 6, 20) > 5
    assert toxicity.g2(6, 0, 6, 20) == pytest.approx(2 * 6 * math.log(26 / 6) + 2 * 20 * math.log(26 / 20))


def test_distinct_words_of_long_texts():
    text = b" ".join(f"w{i}".encode() for i in range(5000)) + b" " + b"x" * 1000
    got = toxicity.distinct_words(text)
    assert len(got) == toxicity.DISTINCT and got == sorted(set(got)) and max(map(len, got)) <= toxicity.BYTES
    assert toxicity.distinct_words(b"b a b") == [b"a", b"b"]


# rules


def test_isolation_paths_by_walking_each_tree():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    forest = rules.Forest(x, trees=20, subsample=64)
    harmonic = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert [float(forest.mean_path(n)) for n in (0, 1, 2, 5, 64)] == pytest.approx([harmonic(n) for n in (0, 1, 2, 5, 64)])
    for row, score in zip(x[:40], forest.score(x[:40])):
        total = 0.0
        for feature, cut, left, right, length in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] < cut[at] else right[at]
            total += length[at]
        assert score == pytest.approx(2 ** (-total / 20 / harmonic(64)))


def test_rules_on_labels_that_set_no_threshold(spark, edge):
    docs, labels = (spark.read.parquet(f"{edge}/{t}.parquet") for t in ("documents", "labels"))
    out = rules.verdicts(docs, labels.where(fold_of() != 0)).collect()
    own = [(r.doc_id % 7 == 0, r.kept) for r in out if r.doc_id is not None and 100 <= r.doc_id < 400 and held(r.doc_id) and not r.base_failed]
    poor, good = [k for p, k in own if p], [k for p, k in own if not p]
    assert len(poor) > 2 and sum(poor) / len(poor) < 0.2 and sum(good) / len(good) > 0.95


# languages


def tiny_languages():
    rng = np.random.default_rng(8)
    say = lambda lang: " ".join("".join(rng.choice(list({"aa": "abcde ", "bb": "abxyz "}[lang]), 6)) for _ in range(30))
    return [(i, say("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(40)]


def test_langid_learns_the_plain_counts_and_takes_the_shortest_code(spark):
    data = tiny_languages()
    docs = spark.createDataFrame([*data, (None, "abc", "aa"), (99, None, "aa"), (98, "abc", None)], "doc_id long, text string, lang string")
    trees = langid.learn(docs)  # at most LEAST of each language: all documents
    counts = {}
    for _, text, lang in data:
        d = b"\0\0\0" + text.lower().encode()
        counts.setdefault(lang, Counter()).update(d[i - 3 : i + 1] for i in range(3, len(d)))
    probe = [t.encode() for _, t, _ in tiny_languages()[:6]] + [b"", b"zebra crossing"]
    want = np.array([[code_length(counts[k], t) for k in ("aa", "bb")] for t in probe])
    assert trees.langs == ["aa", "bb"] and np.allclose(trees.bits(probe), want, rtol=1e-5)
    asked = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(probe)], "doc_id long, text string")
    for r in langid.identify(asked, trees).collect():
        if r.doc_id != 6:
            b = want[r.doc_id]
            assert r.lang_pred == ["aa", "bb"][b.argmin()] and r.score == pytest.approx(1 / np.exp2(b.min() - b).sum(), rel=1e-3)


def test_langid_trees_of_a_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame(tiny_languages(), "doc_id long, text string, lang string")
    whole = langid.learn(docs)
    monkeypatch.setattr(langid, "CELLS", 200)
    small = langid.learn(docs)
    assert len(small.codes[3]) * 2 <= 200 < len(whole.codes[3]) * 2
    probe = [t.encode() for _, t, _ in tiny_languages()]
    assert [int(i) for i in small.bits(probe).argmin(1)] == [0 if i % 2 else 1 for i in range(40)]


# nearest neighbours


def test_ann_recall_where_few_rows_are_reranked(spark, tmp_path):
    """20 000 rows in batches of 8 192, of which 64 are scored exactly for each query: the codes must find the others."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (50, 32))
    x = (centres[rng.integers(0, 50, 20_000)] + rng.normal(0, 0.7, (20_000, 32))).astype(np.float32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    try:
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"vec_id": np.arange(20_000), "embedding": pa.array(list(x))}), str(tmp_path / "embeddings.parquet"))
        table = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
        got = {}
        for r in ann.search(table, table.where("vec_id % 400 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hits = 0
    for q in range(0, 20_000, 400):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits / (10 * 50) >= 0.9


# byte pairs


def test_bpe_of_a_text_beyond_a_stretch():
    import public_tokenizers as P
    from test_operators import tokenizer

    own = tokenizer()
    vocabulary = bpe.Vocabulary(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    text = " ".join(f"word{i % 5000} und Übergröße" for i in range(60_000))
    assert len(text) > bpe.STRETCH
    ids, counts = bpe.Encoder(vocabulary).encode(["a b", text])
    want = own.encode_ordinary("a b") + own.encode_ordinary(text)
    assert ids.tolist() == want and counts.sum() == len(want)


# trees


def test_bk_edges_are_distances_and_the_forest_is_whole():
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**63))
    fps = np.array(sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 24, rng.integers(0, 8))) for _ in range(900)}), np.uint64)
    rng.shuffle(fps)
    tree = simhash.BKTree(fps)
    seen = 0
    for node, kids in enumerate(tree.kids):
        for edge, child in kids:
            below = tree.below(child)
            assert {int(np.bitwise_count(fps[m] ^ fps[node])) for m in below} == {edge} and below.min() == child
            seen += 1
    assert seen == len(fps) - 1 and sorted(tree.order.tolist()) == list(range(len(fps)))
    for block in (512, 7):
        u, edges = Union(), list(zip(*simhash.forest(fps, 4, block)))
        for i, j in edges:
            assert int(fps[i] ^ fps[j]).bit_count() <= 4 and u.find(i) != u.find(j)
            u.join(i, j)
        want = Union()
        for i in range(len(fps)):
            for j in range(i):
                if int(fps[i] ^ fps[j]).bit_count() <= 4:
                    want.join(i, j)
        assert [u.find(i) for i in range(len(fps))] == [want.find(i) for i in range(len(fps))]


def test_folds(spark):
    got = {r.doc_id: r.f for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", (fold_of() == 0).alias("f")).collect()}
    assert got == {i: held(i) for i in range(50)}
