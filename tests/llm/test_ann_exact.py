"""Nearest neighbours of rows that codes tell badly apart: none of the truly nearest is missed."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.llm import ann


def _clusters(rng):
    return rng.normal(0, 1, (10, 16))[rng.integers(0, 10, 12_000)] + rng.normal(0, 0.002, (12_000, 16))


def _shifted(rng):
    return 5_000 + rng.normal(0, 1, (12_000, 16))


def _spread(rng):
    return rng.normal(0, 1, (12_000, 16)) * np.exp(rng.normal(0, 3, (12_000, 1)))


def _huge(rng):
    x = rng.normal(0, 1, (12_000, 16))
    x[::1_000] *= 1e20
    return x


def _copies(rng):
    return rng.normal(0, 1, (40, 16))[rng.integers(0, 40, 12_000)]


@pytest.mark.parametrize("made", [_clusters, _shifted, _spread, _huge, _copies])
def test_ann_finds_the_nearest_of_any_rows(spark, tmp_path, made):
    x = made(np.random.default_rng(8)).astype(np.float32).astype(float)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), str(tmp_path / "e.parquet"))
    table = spark.read.parquet(str(tmp_path / "e.parquet"))
    got = {}
    for r in ann.search(table, table.where("vec_id % 500 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.score
    assert sorted(got) == list(range(0, len(x), 500))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [found[i + 1] for i in range(10)] == pytest.approx(np.sort(d)[:10].tolist())
