"""Licence scans over a positional rare-token index.

The templates (licence notices and identifier lines) are indexed once: word -> positions in each. First every document is
counted for the words of the templates, which gives each word's inverse document frequency over the whole corpus. Then a
text's words get postings, and each template is looked up by its words of highest IDF: every posting of one names the
relative position (place in the text minus place in the template) at which the template would start. Words are taken by
falling IDF until those left couldn't reach the share asked for, so no start is missed; postings are intersected by
relative position, where the words that line up are summed by IDF, first of the rare words, then, at starts that can still
reach the share, of the others. Last, a mandatory key phrase is verified by a start that has enough. Every template is
judged by its own words, so one notice never hides another. Base phrases are found by the postings of their rarest word.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case (A-Z only).

Defined cases: a null or wordless text has no words, places or labels (empty strings, score 0); all places count,
overlapping ones too; texts of any length are read whole, in pieces of about PIECE bytes that share words enough for any
notice; repeated rows are each scanned; an empty table gives an empty result; other columns are left out.

Scale: two scans and no shuffle but the word counts (a row a template word and task). The index and the IDF table have
a row per template word, a bound that doesn't depend on the corpus. Work beyond the scan is a posting of a rare word each, and the other words only where
the rare ones line up.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Everything but letters, digits and bytes beyond ASCII becomes a space; A-Z become a-z.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Phrases whose places are all counted.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
#: label -> notice, mandatory key phrases (one of them must stand by the aligned part). The wording of the
#: public notices.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["any person obtaining a copy of this software"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "lgpl": ("this library is licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    "agpl-3": ("this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2", "mozilla public license version 2"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    "cc-by-nc": ("this work is licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-sa": ("this work is licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc0": ("to the extent possible under law the author has waived all copyright under cc0 1 0", ["cc0 1 0"]),
    "bsd-3": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy of the software and accompanying documentation"]),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable for any damages arising from the use of this software"]),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"]),
    "epl-1": ("this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ["eclipse public license v1 0"]),
    "eupl": ("licensed under the eupl version 1 2", ["eupl version 1 2"]),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    "ofl": ("this font software is licensed under the sil open font license version 1 1", ["sil open font license"]),
    "artistic-2": ("this program is licensed under the artistic license 2 0", ["artistic license 2 0"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
}
#: Further wordings: label, notice, mandatory key phrases. Fixed values too.
HEADERS = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 3", "gnu general public license as published by the free software foundation version 3"]),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 2", "gnu general public license as published by the free software foundation version 2"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license as published"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license as published"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under cc by 4 0", ["cc by 4 0"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("bsd-3", "licensed under the bsd 3 clause license", ["bsd 3 clause license"]),
    ("bsd-2", "licensed under the bsd 2 clause license", ["bsd 2 clause license"]),
    ("gpl-3", "gplv3", ["gplv3"]),
    ("gpl-2", "gplv2", ["gplv2"]),
    ("lgpl", "lgplv3", ["lgplv3"]),
    ("agpl-3", "agplv3", ["agplv3"]),
]
#: Short identifiers as they stand in identifier lines, by label. Fixed values too.
IDENTIFIERS = {
    "agpl-3": ["AGPL-3.0"], "apache-2": ["Apache-2.0"], "artistic-2": ["Artistic-2.0"], "boost": ["BSL-1.0"], "bsd-2": ["BSD-2-Clause"], "bsd-3": ["BSD-3-Clause"],
    "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "epl-1": ["EPL-1.0"], "epl-2": ["EPL-2.0"], "eupl": ["EUPL-1.2"],
    "gpl-2": ["GPL-2.0"], "gpl-3": ["GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.1", "LGPL-3.0"], "mit": ["MIT"], "mpl-2": ["MPL-2.0"], "ofl": ["OFL-1.1"],
    "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}
#: Share of a notice's weight that must line up.
ENOUGH = 0.5
#: Bytes of a text whose words are held at once (about).
PIECE = 1 << 20


def pieces(text: bytes, size: int | None = None):
    """The words of a text, piece by piece."""
    data, lo, size = text.translate(WORDS), 0, size or PIECE
    while lo < len(data):
        cut = len(data) if len(data) - lo <= size else data.find(b" ", lo + size)
        cut = len(data) if cut < 0 else cut
        yield data[lo:cut].split()
        lo = cut


class Index:
    """The templates and phrases as numbers of words."""

    def __init__(self, base=BASE, templates=TEMPLATES, headers=HEADERS, identifiers=IDENTIFIERS):
        split = lambda x: x.encode().translate(WORDS).split()
        every = [(label, *own) for label, own in templates.items()] + headers
        lines = [(label, f"SPDX-License-Identifier: {x}") for label, xs in identifiers.items() for x in xs]
        self.templates = [(label, split(notice), [split(k) for k in keys]) for label, notice, keys in every + [(label, x, [x]) for label, x in lines]]
        self.base = [(p.split(), label) for p, label in base.items()]
        self.templates += [(label, words, [words]) for words, label in self.base]
        self.words = frozenset(w for _, notice, keys in self.templates for part in (notice, *keys) for w in part)
        self.number = {w: i for i, w in enumerate(sorted(self.words))}
        #: Every label needs one of these phrases whole: without all words of any of them a text has no label and no place.
        self.needed = {frozenset(k) for _, _, keys in self.templates for k in keys}
        #: Words that a piece shares with the one before: the reach of any notice and its key phrase.
        self.shared = 4 * max(len(notice) for _, notice, _ in self.templates)
        self.idf, self.weighed = None, []

    def weigh(self, idf: dict[bytes, float]):
        """For each template: the weights of its places, their sum, and its rarest places, without which it can't have enough."""
        if idf is not self.idf:
            self.weighed = []
            for _, notice, _ in self.templates:
                weights = [idf.get(w, 0.0) for w in notice]
                whole, left, rarest = sum(weights), sum(weights), []
                for i in sorted(range(len(notice)), key=lambda i: -weights[i]):
                    if left < ENOUGH * whole * (1 - 1e-9):
                        break
                    rarest.append(i)
                    left -= weights[i]
                self.weighed.append((weights, whole, rarest))
            self.idf = idf
        return self.weighed

    def postings(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The numbers of the words (-1 for those of no template), and the places of each number."""
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        known = known[np.argsort(ids[known], kind="stable")]
        return ids, np.split(known, np.searchsorted(ids[known], np.arange(1, len(self.number))))

    def places(self, ids: np.ndarray, at: list[np.ndarray], phrase: list[bytes]) -> np.ndarray:
        """Every start of phrase: the places of its rarest word here, each verified."""
        own = [self.number[w] for w in phrase]
        i = min(range(len(own)), key=lambda j: len(at[own[j]]))
        starts = at[own[i]] - i
        starts = starts[(starts >= 0) & (starts <= len(ids) - len(own))]
        for j, w in enumerate(own):
            starts = starts[ids[starts + j] == w]
        return starts

    def aligned(self, ids: np.ndarray, at: list[np.ndarray], notice: list[bytes], keys: list[list[bytes]], weighed: tuple) -> float:
        """The largest share of a notice's weight that lines up at a start with a key phrase by it; 0 below ENOUGH."""
        weights, whole, rarest = weighed
        n, least = len(notice), ENOUGH * (1 - 1e-9)
        if not whole:
            return 0.0
        own = [self.number[w] for w in notice]
        # postings intersected by relative position: how much of the rare words' weight each start has
        found = [at[own[i]] - i for i in rarest]
        starts, which = np.unique(np.concatenate(found), return_inverse=True)
        share = np.bincount(which, np.repeat([weights[i] for i in rarest], [len(f) for f in found]), len(starts)).astype(float)
        left = whole - sum(weights[i] for i in rarest)
        for j in sorted(set(range(n)) - set(rarest), key=lambda j: -weights[j]):
            able = share + left >= least * whole
            starts, share = starts[able], share[able]
            place = starts + j
            here = (place >= 0) & (place < len(ids))
            share[here] += weights[j] * (ids[place[here]] == own[j])
            left -= weights[j]
        able = share >= least * whole
        starts, share = starts[able], share[able]
        by = np.zeros(len(starts), bool)
        for key in keys if len(starts) else ():
            # a key phrase from k0 to k1 stands by a start from k1 - 2 n to k0 + n
            k0 = self.places(ids, at, key)
            by |= np.searchsorted(k0, starts - n) < np.searchsorted(k0, starts + 2 * n - len(key), "right")
        return float(share[by].max() / whole) if by.any() else 0.0

    def scan(self, text: bytes, idf: dict[bytes, float], size: int | None = None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        weighed = self.weigh(idf)
        total = count = 0
        first = last = None
        based, labels, score, held = set(), set(), 0.0, []
        for new in pieces(text, size):
            words, own, offset = held + new, len(held), total - len(held)
            total += len(new)
            held = words[-self.shared :]
            here = self.words.intersection(words)
            if not any(map(here.issuperset, self.needed)):
                continue
            ids, at = self.postings(words)
            for phrase, label in self.base:
                got = self.places(ids, at, phrase)
                got = got[got + len(phrase) > own] + offset  # others were counted before
                if len(got):
                    based.add(label)
                    count += len(got)
                    first = int(got[0]) if first is None else min(first, int(got[0]))
                    last = int(got[-1]) if last is None else max(last, int(got[-1]))
            for (label, notice, keys), own_weights in zip(self.templates, weighed):
                if any(map(here.issuperset, keys)) and (share := self.aligned(ids, at, notice, keys, own_weights)):
                    labels.add(label)
                    score = max(score, min(1.0, share))
        labels |= based
        return total, count, first, last, ",".join(sorted(based)), ",".join(sorted(labels)), 1.0 if based else score


def document_frequency(docs: DataFrame, idx: Index, text: str = "text") -> DataFrame:
    """word, df over all documents, for the words of the index."""

    def run(batches):
        counts: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for x in b.column(0).to_pylist():
                for w in set().union(*(idx.words.intersection(words) for words in pieces(x or b""))):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "df"])

    part = docs.select(F.col(text).cast("binary")).mapInArrow(run, "word string, df long")
    return part.groupBy("word").agg(F.sum("df").alias("df"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", idx: Index | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    idx = idx or Index()
    n = docs.count()
    idf = {r.word.encode(): math.log(1 + n / r.df) for r in document_frequency(docs, idx, text).collect()}
    shared = docs.sparkSession.sparkContext.broadcast((idx, idf))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        idx, idf = shared.value
        for b in batches:
            rows = [idx.scan(x or b"", idf) for x in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(
        run, f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
