"""Runs, phrases and BPE with word ends, against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from compare import duck_rows, spark_rows

from corpusmill.llm import phrases, registry, runs, word_bpe

QUERIES = registry.queries()
ODD = ["<|endoftext|>", "a<|endoftext|><|startoftext|>b", "<|EndOfText|>", "İSTANBUL ΑΣ Σ", "\x1c\x1d\x85\xa0a", "don't WE'LL it's '", "é Ᲊ ࢏ a", "x" * 5000, "ab" * 4000, ""]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_of(w, least=24, repeats=3):
    """Stretches whose words equal those q on, for each q; the least q of a stretch is its period."""
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(least, repeats * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def without_repeats(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("least,repeats", [(24, 3), (2, 2), (10, 2), (60, 4)])
def test_runs_of_random_words(least, repeats):
    rng = random.Random(least)
    texts = ["", " ", "a", "a " * 500, "a b " * 300 + "c", "a b c a b " * 40]
    for _ in range(300):
        w = [rng.choice("abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 20])]) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            if len(w) > 30:
                a = rng.randrange(len(w))
                p = rng.randint(1, max(1, (len(w) - a) // 3))
                for i in range(a + p, rng.randint(a, len(w))):
                    w[i] = w[i - p]
        texts.append(" ".join(w))
    got = list(runs.judged([t.encode() for t in texts], [None] * len(texts), None, least, repeats))
    for text, (n, found, rest) in zip(texts, got):
        w = words(text)
        expected = runs_of(w, least, repeats)
        assert n == len(w) and list(map(tuple, found.tolist())) == expected
        assert rest.decode() == without_repeats(w, expected)


def test_runs_cells_in_chunks(monkeypatch):
    text = b"x y " * 200 + b"p q r s " * 30 + b"z " * 99
    whole = list(runs.judged([text, text], [1, 2], None, 24, 3))
    monkeypatch.setattr(runs, "CELLS", 7)
    parts = list(runs.judged([text, text], [1, 2], None, 24, 3))
    assert all(np.array_equal(a[1], b[1]) for a, b in zip(whole, parts)) and len(whole[0][1]) == 3


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op11(spark, sf, edge, where):
    docs = spark.read.parquet(f"{sf if where == 'sf' else edge}/documents.parquet")
    expected = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = words(text)
        n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        if n < 5000:
            found = runs_of(w)
        else:  # too long for the plain way; held against it above
            found = [tuple(r) for r in next(runs.judged([" ".join(w).encode()], [None], None, 24, 3))[1].tolist()]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected[(doc_id, len(found), *four, sha(lines), sha(without_repeats(w, found)))] += 1
    got = QUERIES["op11_runs"](spark, sf if where == "sf" else edge)
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.select(*cols).collect())) == expected
    assert any(k[1] for k in expected)


def test_runs_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a " * 30, "kept", 7), (2, None, None, None)], "id long, text string, runs string, n_words long")
    got = {r.id: r for r in runs.with_runs(docs).collect()}
    assert got[1].n_words == 30 and [tuple(r) for r in got[1].runs] == [(0, 30, 1)] and got[1].collapsed == b"a"
    assert got[2].n_words == 0 and got[2].runs == [] and got[2].collapsed == b""
    # the text itself may have a column's name
    again = docs.select("id", docs.text.alias("collapsed"))
    assert {r.id: r.collapsed for r in runs.with_runs(again, "collapsed").collect()} == {1: b"a", 2: b""}
    assert "Exchange" not in runs.with_runs(docs)._jdf.queryExecution().toString()


def best_phrases(rows, least, share, top):
    lower = {i: i + 32 for i in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    able = [k for k in f if len(k[1]) > 1 and f[k] >= least]
    out = {}
    for lang, p in able:
        a = f[lang, p]
        inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        if any(x == lang and inside(q) and 100 * f[x, q] >= share * a for x, q in able):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang in out for i, (s, a, p, left, right) in enumerate(sorted(out[lang])[:top], 1)}


@pytest.mark.parametrize("shard", [64, 12_000_000])
def test_phrases(spark, monkeypatch, shard):
    rng = random.Random(shard)
    rows = [("en", None), (None, ""), (None, "a b a b a b"), ("en", ". , A\tb!\x0bA b\x0cc\r\n"), ("en", "it it it it it it"), ("de", "x" * 500 + " y " + "é ü " * 60)]
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "C", "dé", "\x85"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    cut = phrases.stretches
    docs = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "lang string, text string, score double, phrase string").repartition(3)
    monkeypatch.setattr(phrases.Shards, "blocks", _blocks_of(shard))
    got = phrases.collocations(docs, least=4, share=80, top=25)
    assert phrases.stretches is cut and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == best_phrases(rows, 4, 80, 25)


def _blocks_of(shard):
    """Shards of another size; as a closure, so that it goes to the workers."""

    def blocks(self, batches):
        from corpusmill.llm.phrases import stretches

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for lead, part in stretches((text or "").encode(), shard):
                    yield [(lang, lead, part)]

    return blocks


def test_phrases_with_full_filters(spark, sf, monkeypatch):
    """Filters that let everything through change nothing."""
    plain = spark_rows(QUERIES["op12_phrases"](spark, sf))
    monkeypatch.setattr(phrases, "filter_of", lambda frequent: np.full(phrases.BITS // 64, 2**64 - 1, np.uint64))
    assert spark_rows(QUERIES["op12_phrases"](spark, sf)) == plain == duck_rows(phrases.ORACLE, sf)


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 300)
    order, ranks = phrases.suffix_ranks(np.r_[ids, np.zeros(4, np.int64)], 4)
    padded = [*ids.tolist(), *[0] * 8]
    prefix = lambda i, m: tuple(padded[i : i + m])
    shared = phrases.lcp(order, ranks)
    inner = [(a, b, n) for a, b, n in zip(order, order[1:], shared[1:]) if max(a, b) < 300]
    for a, b, n in inner:
        assert n == max(m for m in range(5) if prefix(a, m) == prefix(b, m))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return word_bpe.Vocabulary(word_bpe.read_ranks(public_tokenizers.path("word_bpe_49k.json")))


def test_word_bpe_equals_library(library, vocabulary):
    rng = random.Random(2)
    texts = list(ODD) + ["".join(rng.choice("abcdefghe  nrst'aa.ssé<>|/w1") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    spans = [(0, 0x24F), (0x300, 0x3FF), (0x400, 0x2FFF), (0x1F000, 0x1FFFF), (0xAC00, 0xD000), (0x10000, 0x10FFFF)]
    texts += ["".join(chr(rng.randint(*rng.choice(spans))) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    ids, counts = word_bpe.Encoder(vocabulary).encode(texts)
    ends = np.r_[0, np.cumsum(counts)]
    for i, own in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == own.ids, texts[i]


def test_word_bpe_in_stretches(library, vocabulary, monkeypatch):
    from corpusmill.llm import bpe

    monkeypatch.setattr(bpe, "STRETCH", 40)
    texts = ["the quick <|endoftext|> brown fox's " * 30, "É" * 100 + " née <|startoftext|>", "Ᲊ x " * 30, "short"]
    ids, counts = word_bpe.Encoder(vocabulary, words=10).encode(texts)
    assert ids.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    assert counts.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pairs_are_compatible_as_merges_say(library, vocabulary):
    """Two tokens are compatible if merging their joined string gives the two, by the merges one after the other."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        merges = {tuple(m): i for i, m in enumerate(json.load(f)["model"]["merges"])}
    rng = random.Random(4)
    tokens = rng.sample(sorted(vocabulary.string), 3000)
    name = library.id_to_token
    inner = [t for t in tokens if not name(t).endswith("</w>")]
    for left, right in zip(inner, rng.sample(tokens, len(inner))):
        text = name(left) + name(right)
        parts = list(text.removesuffix("</w>"))
        if text.endswith("</w>"):
            parts[-1] += "</w>"
        while pairs := [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert vocabulary.fits(left, right) == (parts == [name(left), name(right)])
        assert bool(vocabulary.compatible(np.array([left]), np.array([right]))[0]) == vocabulary.fits(left, right)


@pytest.mark.parametrize("where", ["sf", "edge"])
def test_op13(spark, sf, edge, library, where):
    root = sf if where == "sf" else edge
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[(d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = QUERIES["op13_word_bpe"](spark, root).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == expected


def test_word_bpe_columns(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Hello there", "x", 2.0), (2, None, None, None)], "id long, text string, ids string, decoded double")
    got = {r.id: r for r in word_bpe.round_trip(docs, word_bpe.read_ranks(public_tokenizers.path("word_bpe_49k.json"))).collect()}
    assert bytes(got[1].decoded) == b"hello</w> there</w>" and len(word_bpe.unpack(got[1].ids)) == 2
    assert got[2].ids == b"" and got[2].decoded == b""


def test_word_bpe_other_files_fail():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError)):
        word_bpe.Vocabulary(word_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json")))
