"""The threshold of the rules' forest comes from all labelled rows."""

import numpy as np

from corpusmill.llm import rules


def test_threshold_over_all_labelled_rows(spark):
    """120 000 rows, more than any sample held: as numpy finds it over all of them, ties to the largest cut."""
    rng = np.random.default_rng(2)
    label = (rng.random(120_000) < 0.9).astype(int)
    s = np.round(np.where(label == 1, rng.beta(4, 6, len(label)), rng.beta(6, 4, len(label))), 5)
    frame = spark.createDataFrame(list(zip(label.tolist(), s.tolist())), "_label int, s0 double").repartition(5)
    a, b = np.sort(s[label == 1]), np.sort(s[label == 0])
    for cost in (10.0, 0.5):
        cuts = np.r_[np.unique(s), 2.0]
        gain = (1 - np.searchsorted(b, cuts) / len(b)) - cost * (1 - np.searchsorted(a, cuts) / len(a))
        at = len(cuts) - 1 - int(np.argmax(gain[::-1]))
        got = rules.best_cut(frame, "s0", len(a), len(b), cost)
        assert abs(got[0] - gain[at]) < 1e-12 and got[1] == cuts[at]
