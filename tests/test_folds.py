"""Folds over sorted streams against plain loops, and on one partition of a million rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import folds, layout


@pytest.fixture(scope="module")
def toc(spark):
    """Entries with nulls, repeated orders and a document of null."""
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([i, i // 3, None]), rng.choice([1, 2, 3, 4, None]), f"t{i}", rng.choice([i, None])) for i in range(400)]
    return data, spark.createDataFrame(data, "document string, ord long, level int, title string, page int").repartition(5)


def first_null(x):
    return (x is not None, x)


def test_parents(toc):
    data, df = toc
    want, open_ = {}, {}
    for doc, at, level, title, _ in sorted(data, key=lambda r: (first_null(r[0]), first_null(r[1]), first_null(r[2]), r[3])):
        above = [x for x in open_.get(doc, []) if level is not None and x[0] < level]
        want[title] = [t for _, t in above]
        open_[doc] = above + ([(level, title)] if level is not None else [])
    assert {r.title: r.parents for r in folds.parents(df).collect()} == want


def test_section_ends(toc):
    data, df = toc
    got = {r.title: r.page_end for r in folds.section_ends(df, 999).collect()}
    assert len(got) == len(data)
    for doc, at, level, title, _ in data:
        later = [] if None in (at, level) else [r for r in data if r[0] == doc and None not in r[1:3] and r[1] > at and r[2] <= level]
        near = [r for r in later if r[1] == min(r[1] for r in later)]
        # of several next entries of one order, any but those that a smaller level of the same order replaces
        assert got[title] in ({999 if r[4] is None else r[4] - 1 for r in near} or {999})


def test_word_lines(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.random() * 60]), rng.choice([None, rng.random()]), f"w{i}") for i in range(300)]
    rank = lambda x: (x is not None, x != x, 0 if x is None or x != x else x)
    want = []
    for page in ("a", "b", None):
        lines, head = [], None
        for _, top, x0, text in sorted((r for r in data if r[0] == page), key=lambda r: (rank(r[1]), rank(r[2]), r[3])):
            if head is None or top is None or not abs(head - top) <= 2:
                lines, head = [*lines, []], top
            lines[-1].append((rank(x0), text))
        want += [(page, i, " ".join(t for _, t in sorted(x))) for i, x in enumerate(lines)]
    df = spark.createDataFrame(data, "page string, top double, x0 double, text string").repartition(4)
    assert {tuple(r) for r in folds.word_lines(df, ["page"]).collect()} == set(want)
    assert folds.word_lines(df.where("false"), ["page"]).collect() == []


def plain_records(lines):
    """The records of one section's lines (page, text) by joining the open text, line by line."""
    action, mark = re.compile(layout.ACTION_START), re.compile(layout.UPDATE_MARKER, re.ASCII)
    out, text, first, last = [], None, None, None
    for page, line in lines:
        if text is None or last is None or page is None or page > last + 1:
            text, first = (line, page) if line is not None and action.search(line) else (None, None)
        elif line is not None:
            text = f"{text} {line}"
        last = page
        if text is not None and mark.search(text):
            out.append((first, last, text))
            text = None
    return out + ([(first, last, text)] if text is not None and len(text) >= layout.TRAILING else [])


def test_records(spark):
    said = ["Refer all [new", "Offer it", "2015] then", "", " ", None, "more [2020] Give", "plain words", "[amended", "1999]", "[new 20", "15]", "Consider a very long line of many words that goes on and on [NEW", "[2001"]
    rng, data = random.Random(6), []
    for section in ["a", "b", "c", None]:
        page = 1
        for i in range(400 if section != "c" else 3):
            page += rng.choice([0] * 12 + [1, 1, 2, -1])
            data.append((section, i, rng.choice([page] * 60 + [None]), rng.choice(said)))
    df = spark.createDataFrame(data, "section string, ord int, page int, text string").repartition(5)
    want = [(s, n + 1, *r) for s in ["a", "b", "c", None] for n, r in enumerate(plain_records([d[2:] for d in data if d[0] == s]))]
    assert len(want) > 40
    got = layout.recommendations(df, ["section"], ["ord"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert layout.recommendations(df.where("false"), ["section"], ["ord"]).collect() == []


def test_a_million_rows_of_one_partition(spark, capsys):
    n = 1_000_000
    rows = spark.range(n).select(F.lit("d").alias("document"), F.col("id").alias("ord"), (F.xxhash64("id") % 5 + 5).cast("int").alias("level"), F.lit("t").alias("title"), F.col("id").alias("page"))
    ends = folds.section_ends(rows, n).agg(F.count("*"), F.count_if(F.col("page_end") >= F.col("page"))).first()
    assert tuple(ends) == (n, n)
    assert folds.parents(rows).agg(F.sum(F.size("parents").cast("long"))).first()[0] > n
    words = spark.range(n).select(F.lit(1).alias("page"), (F.floor(F.col("id") / 4) * 3).alias("top"), F.col("id").alias("x0"), F.lit("w").alias("text"))
    lines = folds.word_lines(words, ["page"])
    assert lines.agg(F.count("*"), F.min("text"), F.max("line")).first() == (n // 4, "w w w w", n // 4 - 1)
    folds.section_ends(rows, n).explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" not in plan and "Aggregate" not in plan


def test_modes(spark):
    said = ["Clinical question: x", "Clinical evidence", "Table 2: y", "Quality of the evidence", "plain", "plain too", "and more", None]
    rng, data = random.Random(7), []
    for section in ("a", "b", None):
        page = 1
        for i in range(200):
            page += rng.random() < 0.2
            data.append(("d", section, rng.choice([page] * 9 + [None]), i, "References" if (section, i) == ("b", 120) else rng.choice(said)))
    set_by = dict(zip(said, ["clinical_question", "evidence", "evidence_table", "rationale"]))
    want = []
    for section in ("a", "b", None):
        mode, record, last = "clinical_context", 0, None
        for _, _, page, i, text in [r for r in data if r[1] == section]:
            if text == "References":
                break
            turned = None not in (page, last) and page != last and mode in ("evidence_table", "rationale")
            record += text in set_by or turned
            mode, last = set_by.get(text, mode), page
            want.append((section, i, mode, record))
    df = spark.createDataFrame(data, "document string, section string, page int, ord int, text string").repartition(4)
    out = layout.modes(df)
    assert {(r.section, r.ord, r.mode, r.record) for r in out.collect()} == set(want)
    assert out.columns == [*df.columns, "mode", "record"]
