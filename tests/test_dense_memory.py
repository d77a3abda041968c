"""The k largest products of a block take little beside the products themselves."""

import tracemalloc

import numpy as np

from corpusmill.functions import dense


def test_largest_sorts_no_whole_block():
    rng = np.random.default_rng(1)
    scores, ids = np.round(rng.normal(0, 1, (500, 800)), 1), rng.permutation(800)
    scores[3, 5:] = np.nan
    tracemalloc.start()
    top, names = dense.largest(scores, ids, 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :11]
    assert np.array_equal(top, np.take_along_axis(scores, by, 1), equal_nan=True) and np.array_equal(names, ids[by])
    assert peak < scores.nbytes / 2
