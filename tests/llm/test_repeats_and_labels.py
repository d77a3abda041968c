"""Rows that share an id, labels other than 0 and 1, and layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, mixing, quality, rules, toxicity, warc


@pytest.mark.parametrize("key", ["lit(7L)", "cast(null as bigint)", "id"])
def test_sample_of_rows_that_share_an_id(spark, key):
    rows = spark.range(60_000).selectExpr(f"{key.replace('lit(7L)', '7L')} AS doc_id", *(f"cast(id * {i + 1} % 997 as double) / 997 AS {s}" for i, s in enumerate(rules.STATS)))
    got = rules._some(rows, "doc_id", 10_000)
    assert abs(len(got) - 10_000) < 600 and np.array_equal(got, rules._some(rows.repartition(7), "doc_id", 10_000))


def test_sample_of_equal_rows(spark):
    rows = spark.range(5_000).select(F.lit(1).alias("doc_id"), *(F.lit(0.5).alias(s) for s in rules.STATS))
    assert abs(len(rules._some(rows, "doc_id", 1_000)) - 1_000) <= 1
    assert len(rules._some(rows, "doc_id", 9_000)) == 5_000


def test_other_labels_do_not_count(spark):
    docs = [(i, ("good words here and more of them " if i % 2 else "idiot scum | | spam ") * 9, "en", "a", 90) for i in range(80)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    plain = [(i, i % 2, 1 - i % 2) for i in range(60)]
    odd = [*plain, (60, 2, 2), (61, -1, -1), (3, 2, 2), (62, None, None)]
    frames = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (plain, odd)]
    for label in ("quality", "toxic"):
        samples = [common.labelled_sample(docs, f, label, 100) for f in frames]
        assert samples[0][1] == samples[1][1] == {0: 30, 1: 30}
        assert sorted(r.doc_id for r in samples[1][0].collect()) == list(range(60))
    for keep in (quality.keep_good, toxicity.drop_toxic, rules.keep):
        kept = [sorted(r.doc_id for r in keep(docs, f).collect()) for f in frames]
        assert kept[0] == kept[1]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_draws_do_not_follow_the_layout(spark, parts):
    rows = [(5, "s" if i % 3 else None, "same words here") for i in range(1000)] + [(None, "t", "x")] * 40 + [(i, "s", "other") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    got = mixing.mix(docs).groupBy("doc_id", "source").count().orderBy("doc_id", "source").collect()
    again = mixing.mix(docs.repartition(5)).groupBy("doc_id", "source").count().orderBy("doc_id", "source").collect()
    assert got == again
    crowd = sum(r["count"] for r in got if r.doc_id == 5)
    assert 1350 < crowd < 1700  # drawn apart, about 1.5 times


def test_one_response_a_group(spark, tmp_path):
    rows = [(9, "u2", "a"), (9, "u1", "a"), (9, "u1", "a"), (3, "u", "a"), (9, "u", "b"), (None, "n", "c"), (None, "n", "c"), (1, "e", ""), (1, "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_records(spark, str(tmp_path / "w")).collect()
    ids = [[x for x in r.header.decode().split("\r\n") if x.startswith("WARC-Record-ID")][0] for r in got]
    assert len(set(ids)) == len(rows)
    kinds = sorted((r.payload.decode(), r.page_id or 0, r.record_type, r.refers_to or 0, r.url) for r in got)
    assert kinds == [
        ("", 1, "response", 0, "e"), ("", 1, "revisit", 1, "e"),
        ("a", 3, "revisit", 9, "u"), ("a", 9, "response", 0, "u1"), ("a", 9, "revisit", 9, "u1"), ("a", 9, "revisit", 9, "u2"),
        ("b", 9, "response", 0, "u"), ("c", 0, "response", 0, "n"), ("c", 0, "response", 0, "n"),
    ]
