"""Prefix scans, ranges by bins and joins by prefix, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import windows


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    """Small ranges stay tasks of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """One partition has most of the rows; null partitions and null marks."""
    rng = random.Random(8)
    data = [(rng.choice(["hot"] * 8 + ["b", None]), i, rng.choice([True, False, False, None]), rng.choice([None, None, i]), "x") for i in range(3000)]
    return data, spark.createDataFrame(data, "k string, t int, starts boolean, v int, _task string").repartition(6)


def test_segments(rows):
    data, df = rows
    out = windows.segments(df, ["k"], ["t"], F.col("starts"))
    seen, want = {}, {}
    for k, t, s, *_ in sorted(data, key=lambda r: r[1]):
        if s is not None:
            seen[k] = seen.get(k, 0) + s
        want[t] = seen.get(k)
    assert out.columns == [*df.columns, "segment"] and {r.t: r.segment for r in out.collect()} == want


@pytest.mark.parametrize("default", [None, -1])
def test_carried(rows, default):
    data, df = rows
    last, want = {}, {}
    for k, t, _, v, _x in sorted(data, key=lambda r: r[1]):
        want[t] = last.get(k, default)
        if v is not None:
            last[k] = v
    out = windows.carried(df, ["k"], ["t"], F.col("v"), "before", default)
    assert {r.t: r.before for r in out.collect()} == want


def test_a_hot_partition_spans_tasks(rows):
    _, df = rows
    dealt, task = windows._dealt(df, ["k"], ["t"], "test")
    assert dealt.where("k = 'hot'").select(task).distinct().count() > 1 and task == "__task"
    assert windows.segments(df.where("false"), ["k"], ["t"], F.col("starts")).collect() == []


def test_within_by_bins(spark, capsys):
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    spans = [(i, lo := rng.choice([0.0, -5.5, 1e-9, 3e6]) * rng.random(), lo + rng.choice([0.0, 1e-12, 0.1, 1.0, 64.0, 5e5]) * rng.choice([1.0, rng.random()])) for i in range(200)]
    spans += [(1000, -inf, 1.0), (1001, 2.0, inf), (1002, 5.0, 4.0), (1003, None, 4.0), (1004, nan, nan), (1005, -inf, inf)]
    values = [(i, rng.choice([v for _, lo, hi in spans[:200] for v in (lo, hi)] + [0.0, rng.random() * 100])) for i in range(400)] + [(900, None), (901, inf), (902, -1e300)]
    a, b = spark.createDataFrame(values, "id int, v double"), spark.createDataFrame(spans, "i int, lo double, hi double")
    want = {(v, i) for v, x in values if x is not None for i, lo, hi in spans if lo is not None and lo == lo and lo <= x <= hi}
    for block in (7, 100_000):
        out = windows.within(a, "v", b, "lo", "hi", block)
        assert {(r.id, r.i) for r in out.collect()} == want and out.columns == ["id", "v", "i", "lo", "hi"]
        out.explain("formatted")
        assert "NestedLoop" not in capsys.readouterr().out
    assert windows.within(a, "v", b.where("false"), "lo", "hi").collect() == []


def test_by_prefix(spark, capsys):
    texts = ["1.2.3", "1.2", "1", "", None, "2.10", "2.1", "é1.2"]
    prefixes = ["1.", "1.2", "2.1", "é", "", None, "1.2.3.4"]
    a = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    b = spark.createDataFrame(list(enumerate(prefixes)), "n int, p string")
    out = windows.by_prefix(a, "t", b, "p")
    assert {(r.id, r.n) for r in out.collect()} == {(i, n) for i, t in enumerate(texts) for n, p in enumerate(prefixes) if None not in (t, p) and t.startswith(p)}
    out.explain("formatted")
    assert "NestedLoop" not in capsys.readouterr().out
    assert windows.by_prefix(a, "t", b.where("false"), "p").collect() == []
