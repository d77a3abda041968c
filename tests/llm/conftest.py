import math
import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and alpha beta gamma delta omega river stone field light house garden winter summer paper glass green".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, fp long, ids array<int>, component_id long, letter boolean, held_out boolean, target double"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


def documents():
    """Rows with nulls in every column, empty, odd and long texts, ties and repeats, and columns with clashing names."""
    rng = random.Random(5)
    clash = (1, 0.5, 3, [1], 9, True, False, 1.0)
    rows = []

    def add(i, text, lang="en", source="a"):
        rows.append((i, text, lang, source, None if text is None else len(text), *clash))

    long_ = prose(rng, 60_000)
    add(1, None)
    add(2, "")
    add(3, " \t\n ")
    add(4, long_)
    add(5, long_ + " end")
    add(6, "x" * 300_000)
    add(7, "née Ünïcödé 漢字 🎉 words here and there", None, None)
    add(8, "123 456 !!! ???", "de", None)
    add(None, prose(rng, 40), "en", "b")
    add(None, None, None, None)
    same = prose(rng, 80)
    for i in (20, 21, 22, 22):
        add(i, same, "fr", "c")
    add(23, same.upper(), "fr", "c")
    add(24, same + " more", "fr", "c")
    for i in range(100, 400):
        bad = " idiot scum clown" if i % 5 == 0 else ""
        text = prose(rng, rng.randint(5, 120))
        if i % 7 == 0:
            text = " | ".join(text.split())
        lang = ["en", "fr", "de"][i % 3]
        text = {"en": text, "fr": text.replace("e", "é"), "de": text.replace("s", "ß")}[lang]
        add(i, text + bad, lang, ["a", "a", "b", "c"][i % 4])
    add(401, "Released under the MIT License. Licensed under the Apache License, Version 2.0; under the MIT license", "en", "a")
    add(402, "This work is licensed under the GNU General Public License, version 3.", "en", "a")
    add(403, "CC BY-NC cc by nc under the mit licensed", "en", "a")
    return rows


@pytest.fixture(scope="session")
def docs_rows():
    return documents()


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory, docs_rows):
    root = str(tmp_path_factory.mktemp("edge"))
    docs = spark.createDataFrame(docs_rows, DOCS)
    docs.coalesce(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 0 if r[0] and r[0] % 7 == 0 else 1, 1 if r[0] and r[0] % 5 == 0 else 0, 1.0) for r in docs_rows if r[0] and r[0] >= 100]
    labels += [(None, 1, 1, 0.0), (4, None, None, 0.0), (100, 1, 1, None), (999_999, 0, 0, 0.0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score double").write.parquet(f"{root}/labels.parquet")
    pages = [(i, f"http://h/{i}", h, 1, "x") for i, h in enumerate(["a", "b", "a", "", None, "é" * 9, "a", "z" * 200_000])]
    pages += [(7, "http://h/7", "z" * 200_000, 1, "x"), (None, "u", "a", 1, "x"), (None, None, "only", 1, "x"), (50, "bad\r\nurl", "q", 1, "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, payload long, sha256 string").write.parquet(f"{root}/pages.parquet")
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(10)]
    rows = [(i, vec(), 1, 0.0) for i in range(1, 500)]
    tie = vec()
    rows += [(i, tie, 1, 0.0) for i in range(500, 700)] + [(100, None, 1, 0.0), (None, vec(), 1, 0.0), (800, [0.0] * 10, 1, 0.0), (801, [math.nan] * 10, 1, 0.0)]
    rows += [(802, [1.0] * 9, 1, 0.0), (900, [None] + [1.0] * 9, 1, 0.0), (200, rows[199][1], 1, 0.0), (1000, [math.inf] + [1.0] * 9, 1, 0.0), (803, [], 1, 0.0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code double").write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory, edge):
    root = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{edge}/{t}.parquet").where(F.lit(False)).write.parquet(f"{root}/{t}.parquet")
    return root
