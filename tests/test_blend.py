"""The blended score's search: difflib's matches, the bounds that rule pairs out, and a plan without pairs of all texts."""

import random
from difflib import SequenceMatcher

import numpy as np


def _matched(old, new):
    return sum(m.size for m in SequenceMatcher(None, old, new).get_matching_blocks())


def _texts(seed, n):
    draw = random.Random(seed)
    alphabets = ["ab ", "abc. 1", "abcdefghijk ", "etaoin shrdlu etaoin etaoin qxz"]
    out = []
    for _ in range(n):
        alphabet = draw.choice(alphabets)
        # difflib leaves frequent characters out from 200 on
        text = "".join(draw.choice(alphabet) for _ in range(draw.choice([0, 1, 3, 10, 50, 199, 200, 201, 300, 450])))
        out.append(draw.choice(out)[draw.randrange(4) :] + text if out and draw.random() < 0.4 else text)
    return out


def test_matches_are_those_of_difflib_and_bounds_hold():
    from corpusmill.functions import ratio

    new = _texts(1, 50)
    block = ratio.Block(new)
    assert block.laid.any() and not block.laid.all()
    for old in _texts(2, 50):
        first, most = ratio.First(old), block.most(old)
        for i, text in enumerate(new):
            want = _matched(old, text)
            assert ratio.matched(first, block.texts[i]) == ratio.matched(first, block.texts[i], want) == want <= most[i]
            assert ratio.matched(first, block.texts[i], want + 1) == -1


def test_texts_beyond_the_bits_are_left_to_difflib(monkeypatch):
    from corpusmill.functions import ratio

    monkeypatch.setattr(ratio, "BITS", 1000)
    old, new = "abc abd " * 20, "abd abc " * 20
    want = _matched(old, new)
    assert ratio.matched(ratio.First(old), ratio.Searched(new)) == want
    assert ratio.matched(ratio.First(old), ratio.Searched(new), want + 1) == -1


def test_few_ratios_are_worked_out(spark, sf):
    from corpusmill.functions import text as T
    from corpusmill.operators import reconcile

    items = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(10).select(T.match_form("text")).collect()]
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(T.match_form("text")).collect()]
    blend = reconcile.Blend(items)
    every = np.array([[0.6 * j + 0.8 * _matched(old, new) / max(len(old) + len(new), 1) for j, new in zip(blend.jaccard(old), items)] for old in docs])
    floor = np.sort(every, axis=0)[-3]
    able = [set(blend.able(old, floor)[0].tolist()) for old in docs]
    # none that reaches the floor is ruled out, and most others are
    assert all(set(np.flatnonzero(own >= floor).tolist()) <= got for own, got in zip(every, able))
    assert sum(map(len, able)) < 0.4 * every.size


def test_blend_of_copies_nulls_and_nothing(spark):
    from corpusmill.functions import text as T
    from corpusmill.operators import reconcile

    new = spark.createDataFrame([(1, "refer adults urgently for imaging"), (2, None), (3, ""), (4, "tree " * 60 + "quartz")], "id int, text string")
    rows = [(i, "refer an adult urgently") for i in range(2000, 0, -1)] + [(3000, None), (None, "refer adults urgently for imaging"), (3001, ""), (3002, "trees of quartz")]
    old = spark.createDataFrame(rows, "id int, text string").repartition(5)
    got = reconcile.best_blend(new, old, 3)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    read = lambda df: [(r.id, r.f, set(r.t)) for r in df.where("id is not null and text is not null").select("id", T.match_form("text").alias("f"), T.match_terms("text").alias("t")).collect()]
    want, seen = set(), {}
    for i, form, a in read(new):
        scores = []
        for d, earlier, b in read(old):
            key = (i, earlier)
            if key not in seen:
                seen[key] = round(0.6 * len(a & b) / (len(a | b) or 1) + 0.4 * SequenceMatcher(None, earlier, form).ratio(), 10)
            scores.append((-seen[key], d))
        want |= {(i, d, n, round(-s, 6)) for n, (s, d) in enumerate(sorted(scores)[:3], 1) if s < 0}
    assert {(r.left_id, r.right_id, r.rank, round(r.score, 6)) for r in got.collect()} == want
    assert reconcile.best_blend(new.limit(0), old, 3).collect() == [] == reconcile.best_blend(new, old.limit(0), 3).collect()
