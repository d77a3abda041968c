import hashlib
from collections import Counter

from test_operators import components, fingerprint, tokenizer, words

import corpus_pipeline
from corpusmill.llm import quality, toxicity
from corpusmill.llm.common import stash, table


def test_stages(spark, sf):
    docs, seen = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, sf), "test-pipeline")
        seen.append((name, docs, out))
        docs = out
    start = {r.doc_id for r in seen[0][1].collect()}
    for name, before, after in seen[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS, name
        assert {r.doc_id for r in after.collect()} <= start
    kept = [{r.doc_id for r in after.collect()} for _, _, after in seen]
    labels = table(spark, sf, "labels")
    from corpusmill.llm.common import fold_of

    first, second, third = (before for _, before, _ in seen[:3])
    model = quality.learn(first.where(fold_of() != 0), labels.where(fold_of() != 0))
    assert kept[0] == {r.doc_id for r in quality.score(first, model, ["doc_id"]).where("predicted = 1").collect()}
    scorer = toxicity.learn(second.where(fold_of() != 0), labels.where(fold_of() != 0))
    assert kept[1] == {r.doc_id for r in toxicity.score(second, scorer).where("predicted = 0").collect()}
    prints = {r.doc_id: fingerprint(r.text) for r in third.collect()}  # brute force: all pairs of fingerprints
    u, least = components(list(prints.values())), {}
    for i, p in sorted(prints.items(), reverse=True):
        least[u.find(p)] = i
    assert kept[2] == set(least.values())
    copies, sizes = Counter(r.doc_id for r in seen[3][2].collect()), Counter()
    for r in seen[3][1].collect():
        sizes[r.source] += len(words(r.text))
    rate = target_rates(sizes)
    for r in seen[3][1].collect():
        u01 = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies[r.doc_id] == int(rate[r.source]) + (u01 < rate[r.source] % 1)
    own = tokenizer()
    source = {r.doc_id: r.text for r in seen[3][2].collect()}
    for r in docs.collect():
        assert list(r.ids) == own.encode_ordinary(source[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()
    assert Counter(r.doc_id for r in docs.collect()) == copies


def target_rates(sizes):
    """Rates by resharing what is above the caps until nothing is."""
    left, target = dict(zip(sorted(sizes), [3, 1, 2] * len(sizes))), {}
    while True:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del left[s]
    target |= {s: w * level for s, w in left.items()}
    return {s: target[s] / sizes[s] for s in sizes}


def test_run_and_empty(spark, sf, empty):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0
