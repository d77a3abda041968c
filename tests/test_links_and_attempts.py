"""Links by classes against all pairs, and the log of attempts under failures."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import judging, reconcile
from corpusmill.sources import files


def test_links(spark):
    rng = random.Random(9)
    some = lambda: rng.choice([None, [], [None], *([rng.sample("abcde", 2) + [None]] * 3), *([rng.choice("abcde"), "a"] for _ in range(3))])
    a = [(i // 2, some()) for i in range(120)] + [(None, ["a"])]
    b = [(i, some()) for i in range(90)]
    members = lambda rows: {i: {k for j, ks in rows if j == i for k in ks or [] if k is not None} for i, _ in rows if i is not None}
    x, y = members(a), members(b)
    want = {(i, j) for i in x for j in y if x[i] & y[j]}
    df = lambda rows: spark.createDataFrame(rows, "id int, sites array<string>").repartition(3)
    found = reconcile.links(df(a), df(b))
    got = [tuple(r) for r in reconcile.expanded(found).collect()]
    assert len(got) == len(want) and set(got) == want
    for side, at in (("support", 0), ("current", 1)):
        per = {}
        for pair in want:
            per.setdefault(pair[at], []).append(pair[1 - at])
        assert {tuple(r) for r in reconcile.linked(found, side).collect()} == {(k, len(v), min(v), max(v)) for k, v in per.items()}
    assert found.classes.count() <= found.support.select("class").distinct().count() * found.current.select("class").distinct().count()
    assert reconcile.linked(reconcile.links(df(a).where("false"), df(b))).collect() == []


def test_links_of_one_large_class_stay_linear(spark):
    """10^10 links from 2 x 10^5 rows."""
    rows = spark.range(100_000).select("id", F.array(F.lit("x"), F.lit("y")).alias("sites"))
    found = reconcile.links(rows, rows)
    assert found.classes.count() == 1
    n = reconcile.linked(found).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(n) == (100_000, 100_000, 100_000)


SCHEMA = "task int, label string"


def rows_of(spark, path):
    return sorted(tuple(r) for r in files.read_attempts(spark, path, SCHEMA, ["task"]).collect())


def test_a_run_that_is_tried_again_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "done")
    work = spark.range(6).select(F.col("id").cast("int").alias("task"))
    judged = lambda label: judging.pending(work, files.read_attempts(spark, path, SCHEMA, ["task"]), ["task"]).withColumn("label", F.lit(label))
    assert rows_of(spark, path) == []
    assert files.append_attempt(judged("a").where("task < 3"), path, "run-1")

    # fails after its rows are written, before they are committed: none of them is read
    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "_on_file_system", lambda s, p, real=files._on_file_system: real(s, p) if "commits/run-2" not in p else fails())
        with pytest.raises(OSError):
            files.append_attempt(judged("c"), path, "run-2")
    assert rows_of(spark, path) == [(i, "a") for i in range(3)]
    # tried again; and once more, after it has been committed
    assert files.append_attempt(judged("d"), path, "run-2")
    assert not files.append_attempt(work.withColumn("label", F.lit("e")), path, "run-2")
    want = [(i, "a" if i < 3 else "d") for i in range(6)]
    assert rows_of(spark, path) == want and judged("f").count() == 0
    assert files.drop_uncommitted(spark, path) == 1 and rows_of(spark, path) == want
    assert len(list(Path(path, "attempts").iterdir())) == 2


def test_work_that_two_runs_did(spark, tmp_path):
    path = str(tmp_path / "done")
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    assert files.append_attempt(make((1, "late"), (2, "x"), (2, "x"), (None, "n")), path, "run-2")
    assert files.append_attempt(make((1, "early"), (3, None)), path, "run-1")
    assert files.append_attempt(make((1, "z")).where("false"), path, "run-3")
    got = {tuple(r) for r in files.read_attempts(spark, path, SCHEMA, ["task"]).collect()}
    assert got == {(1, "early"), (2, "x"), (3, None), (None, "n")}
    for name in ("", "_x", "a/b", ".x", "a b"):
        with pytest.raises(ValueError):
            files.append_attempt(make(), path, name)


def test_an_unfilled_mark_is_not_a_commit(spark, tmp_path):
    path = tmp_path / "done"
    (path / "commits").mkdir(parents=True)
    (path / "commits" / "run-1").touch()
    rows = spark.createDataFrame([(1, "a")], SCHEMA)
    assert rows_of(spark, str(path)) == []
    assert files.append_attempt(rows, str(path), "run-1") and rows_of(spark, str(path)) == [(1, "a")]


def test_links_from_either_side_give_all_ids(spark):
    """Every link is in a list, however the classes overlap."""
    df = lambda rows: spark.createDataFrame(rows, "id long, sites array<string>")
    a, b = [(i, [f"s{i % 3}", f"s{i % 5}"]) for i in range(40)], [(i, [f"s{i % 4}"]) for i in range(100, 130)]
    found = reconcile.links(df(a), df(b))
    for side, own, other in (("support", a, b), ("current", b, a)):
        want = {i: sorted(j for j, y in other if set(x) & set(y)) for i, x in own}
        got = {r[f"{side}_id"]: (r.n, r.ids) for r in reconcile.linked(found, side, ids=True).collect()}
        assert got == {i: (len(x), x) for i, x in want.items() if x}
