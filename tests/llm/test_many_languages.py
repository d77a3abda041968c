"""Language trees at 200 languages keep to their memory, and labelled texts are learned from whole."""

import pickle
import tracemalloc

import numpy as np

from corpusmill.llm import langid


def test_two_hundred_languages_at_the_cap():
    rng, k = np.random.default_rng(2), 200
    grams = np.unique(rng.integers(0x61616161, 0x7A7A7A7A, langid.CELLS // k))
    n = 8 * len(grams)
    lang, at = rng.integers(0, k, n), rng.integers(0, len(grams), n)
    tracemalloc.start()
    trees = langid.Trees([f"l{i:03}" for i in range(k)], lang, grams[at], rng.integers(1, 50, n).astype(float))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sent = len(pickle.dumps(trees))
    assert peak < 600_000_000 and sent < 100_000_000, (peak, sent)


def test_counts_of_whole_texts_in_parts(monkeypatch):
    """The same grams however texts are cut for counting."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, rng.integers(1, 400), np.uint8)) for _ in range(40)]
    whole = np.sort(np.concatenate([langid.grams(np.frombuffer(b"\0\0\0" + t, np.uint8)) for t in texts]))
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(langid, "COUNTED", size)
        parts = [langid.grams(x) for run in langid._runs(texts) for x in run]
        assert np.array_equal(np.sort(np.concatenate(parts)), whole)


def test_a_language_is_learned_from_the_end_of_a_long_text(spark):
    """What one language's only document says stands after 200 000 bytes that both languages share."""
    same = "qqq " * 50_000
    rows = [(1, same + "zwei drei vier " * 50, "de"), (2, same + "deux trois quatre " * 50, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = langid.learn(docs)
    asked = spark.createDataFrame([(3, "trois quatre deux"), (4, "vier zwei drei")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, trees).collect()} == {3: "fr", 4: "de"}
