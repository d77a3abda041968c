import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, models


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "t": "é"}\n\n{"id": 2, "t": null}\n', encoding="utf-8")
    rows = files.read_json_lines(spark, str(p), "id int, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "é"), (2, None)]
    files.write_json_lines(rows, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out"), "id int, t string").count() == 2
    p.write_text('{"id": 1, broken\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(p), "id int, t string").collect()


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿"Case ID",Answer\r\nc1,"two\nlines, ""quoted"""\r\n'.encode())
    rows = files.read_csv(spark, str(p), ["Case ID", "Answer"])
    assert [tuple(r) for r in rows.collect()] == [("c1", 'two\nlines, "quoted"')]
    files.write_csv(rows, str(tmp_path / "out"), ["Final"])
    assert files.read_csv(spark, str(tmp_path / "out"), ["Case ID", "Answer", "Final"]).first().Final is None


def test_index_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "chunk_id string, embedding array<double>")
    path = str(tmp_path / "index")
    files.write_index(vectors, chunks, path, "m")
    assert files.open_index(spark, path, chunks.orderBy(F.desc("chunk_id")), "m").count() == 2
    with pytest.raises(ValueError, match="corpus"):
        files.open_index(spark, path, chunks.withColumn("text", F.lit("z")), "m")
    with pytest.raises(ValueError, match="model"):
        files.open_index(spark, path, chunks, "n")
    files.write_index(vectors.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0))), chunks, path, "m")
    with pytest.raises(ValueError, match="unnormalised"):
        files.open_index(spark, path, chunks, "m")


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "done")
    assert files.read_checkpoint(spark, path, "id int").count() == 0
    for i in (1, 2):
        files.append_checkpoint(spark.createDataFrame([(i,)], "id int"), path)
    assert sorted(r.id for r in files.read_checkpoint(spark, path, "id int").collect()) == [1, 2]


def test_models(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "")], "id int, text string")

    def lengths():
        return lambda texts: [[len(t), 1.0] for t in texts]

    got = {r.id: r.embedding for r in models.embed(rows, lengths, prefix="q").collect()}
    assert got[2] == pytest.approx([0.5**0.5, 0.5**0.5])

    def shout():
        return lambda texts: [t.upper() for t in texts]

    assert {r.answer for r in models.generate(rows, shout, "text").collect()} == {"AB", ""}


def test_retry():
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 2:
            raise OSError
        return batch

    assert models.retried(flaky, longest=0)([1]) == [1] and len(calls) == 2
    with pytest.raises(OSError):
        models.retried(lambda b: (_ for _ in ()).throw(OSError()), 2, 0)([1])
