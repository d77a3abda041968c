"""BPE with word ends: a backtracking encoder over longest token matches, and decoding by an offset table.

A tokenizers file names the special tokens, the vocabulary and the merges. A text is cut at special tokens (as they stand
in the raw text), the rest is composed (NFC), lower-cased character by character and parted into words by the file's
pattern. A word is a sequence of symbols: its bytes, of which the last one is marked as the word's end.

A segmentation into tokens is what the merges give exactly if every two neighbours are compatible: merging their two
strings alone gives these two tokens back (`Vocabulary.compatible`, which undoes the two tokens' merges along the cut and
looks for a merge across it that would have come first). So an Aho-Corasick automaton cuts all new words of a block into
longest tokens, all neighbours are looked up at once, and only words with an incompatible pair are encoded by backtracking
(`Vocabulary.backtrack`): the longest token at a place, else its longest prefix that is a token, else a step back; a place
that failed is never tried again, so the time is linear in the word. Tokens that their own string isn't encoded to are
left out of the automaton. Ids of a word are kept for later blocks, up to a bound (see corpusmill.llm.bpe).

Decoding looks each id's string up by its offset in the joined strings and puts one space between tokens, as a file
without a decoder asks for.

Defined cases: a null text is an empty one (no ids); texts of any length are taken whole; a text with code points that
this Python's Unicode tables don't know is normalised and parted by the tokenizers library, whose tables are newer, so
that results agree; an id outside the vocabulary fails, and so does a file of another kind (another model, normalizer,
pattern, or added tokens that strip or match single words); an empty table gives an empty result; other columns pass
through, except that columns named ids or decoded are replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .bpe import Encoder, _decoded, _encoded, read_ranks
from .common import table

#: What the file must say for the words to be parted as here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
END = "</w>"
#: No limit yet on the rank of a merge across a cut.
FREE = np.int64(2**62)
#: Pairs whose compatibility a task keeps.
SEEN = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Word:
    """What a match object is asked for."""

    def __init__(self, word: str):
        self.word = word

    def group(self) -> str:
        return self.word


class Splitter:
    """The words of a text and its special tokens, in order."""

    def __init__(self, special: list[str], source: str):
        self.source, self.special = source, set(special)
        by_length = sorted(special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if special else None
        self.wide = regex.compile(PATTERN)
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self.library, self.assigned = None, set()

    def _known(self, piece: str) -> bool:
        """Whether this Python's tables know all code points of the piece."""
        new = set(piece) - self.assigned
        out = not any(unicodedata.category(c) == "Cn" for c in new)
        if out:
            self.assigned |= new
        return out

    def _pieces(self, text: str):
        return self.cut.split(text) if self.cut else [text]

    def _matches(self, piece: str, every: bool):
        """The words of a piece without special tokens: a list, or an iterator over matches."""
        if piece.isascii():
            own, low = self.ascii, piece.lower()
        elif not self._known(piece):
            words = self._by_library(piece)
            return words if every else map(Word, words)
        else:
            own = self.wide
            low = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()  # no final sigma by its context
        return own.findall(low) if every else own.finditer(low)

    def _by_library(self, piece: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        low = self.library.normalizer.normalize_str(piece)
        return [low[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def findall(self, text: str) -> list[str]:
        out = []
        for piece in self._pieces(text):
            if piece in self.special:
                out.append(piece)
            elif piece:
                out += self._matches(piece, True)
        return out

    def finditer(self, text: str):
        for piece in self._pieces(text):
            if piece in self.special:
                yield Word(piece)
            elif piece:
                yield from self._matches(piece, False)


class Vocabulary:
    """Tokens, merges and what follows from them: compatible pairs, longest matches, strings by offset."""

    def __init__(self, source: bytes):
        read = json.loads(source)
        model, added = read["model"], read["added_tokens"]
        steps = read["pre_tokenizer"]["pretokenizers"]
        if (
            model["type"] != "BPE"
            or model["end_of_word_suffix"] != END
            or [n["type"] for n in read["normalizer"]["normalizers"]] != NORMALIZERS
            or steps[0]["pattern"] != {"Regex": PATTERN}
            or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or read["decoder"] is not None
            or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        ):
            raise ValueError("not a BPE file with word ends of the kind that this module encodes by")
        letters, vocab = byte_letters(), model["vocab"]
        self.split = Splitter([a["content"] for a in added], source.decode())
        self.special = {a["content"].encode(): a["id"] for a in added}
        names = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in added}
        size = max(names, default=-1) + 1
        lengths = np.zeros(size, np.int64)
        strings = [names.get(i, "").encode() for i in range(size)]
        self.known = np.array([i in names for i in range(size)], bool)
        # the offset table: each token's string and the space that parts it from the next
        lengths = np.array([len(s) + 1 if k else 0 for s, k in zip(strings, self.known)], np.int64)
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.bytes = np.frombuffer(b"".join(s + b" " for s, k in zip(strings, self.known) if k), np.uint8)

        def symbols(token: str) -> str:
            ends = token.endswith(END)
            own = [letters[c] for c in (token[: -len(END)] if ends else token)]
            return "".join(map(chr, own[:-1])) + chr(own[-1] + 256 * ends)

        self.base = np.full(512, -1, np.int32)
        for token, i in vocab.items():
            if len(token.removesuffix(END) or END) == 1 and (s := symbols(token)):
                self.base[ord(s)] = i
        # ranks: single symbols come first, then merges in their order; a token is made by one merge
        self.order = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        own = self.base[self.base >= 0]
        self.order[own] = np.arange(len(own))
        made, pairs = [], {}
        for rank, (a, b) in enumerate(model["merges"]):
            token, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.order[token] >= 0:
                raise ValueError("a token is made by two merges")
            self.order[token] = 512 + rank
            self.left[token], self.right[token] = a, b
            pairs[a << 32 | b] = 512 + rank
            made.append(token)
        self.pairs = np.array([*sorted(pairs), FREE], np.int64)
        self.ranks = np.array([*(pairs[p] for p in self.pairs[:-1].tolist()), FREE], np.int64)
        made = np.array(made, np.int64)
        sound = np.zeros(size, bool)  # tokens that their own string is encoded to
        sound[own] = True
        whole = self.compatible(self.left[made], self.right[made], self.order[made])
        for token, able in zip(made.tolist(), whole.tolist()):
            sound[token] = able and sound[self.left[token]] and sound[self.right[token]]
        self.string = {int(i): symbols(names[int(i)]) for i in np.flatnonzero(sound)}
        number = {s: i for i, s in self.string.items()}
        self.shorter = {}  # the longest proper prefix of a token that is a token
        self.matches = ahocorasick.Automaton()
        for s, i in number.items():
            self.matches.add_word(s, i)
            self.shorter[i] = next((number[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in number), None)
        self.matches.make_automaton()
        self.size = np.zeros(size, np.int64)
        for i, s in self.string.items():
            self.size[i] = len(s)
        self.length, self.order_of, self.left_of, self.right_of = (x.tolist() for x in (self.size, self.order, self.left, self.right))
        self.rank_of, self.seen = pairs, {}

    def compatible(self, left: np.ndarray, right: np.ndarray, limit=FREE) -> np.ndarray:
        """For each two tokens whether no merge across their cut comes before those that made them (or before limit)."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        limit = np.broadcast_to(np.asarray(limit, np.int64), left.shape).copy()
        out, at = np.ones(len(left), bool), np.arange(len(left))
        while len(at):
            code = left << 32 | right
            place = np.searchsorted(self.pairs, code)
            rank = np.where(self.pairs[place] == code, self.ranks[place], FREE)
            crossed = rank < limit
            out[at[crossed]] = False
            # undo the later of the two merges; of two equal ones the left one was made first, so the right one is undone
            first, second = self.order[left], self.order[right]
            undo = first > second
            single = np.where(undo, self.left[left] == left, self.left[right] == right)
            limit = np.where(undo, first, second + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
            on = ~crossed & ~single  # the later one being a symbol, both are
            at, left, right, limit = at[on], left[on], right[on], limit[on]
        return out

    def fits(self, left: int, right: int) -> bool:
        """compatible, of one pair: from the table of pairs met, else by the same steps."""
        code = left << 32 | right
        known = self.seen.get(code)
        if known is None:
            if len(self.seen) > SEEN:
                self.seen.clear()
            known = self.seen[code] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        ranks, order, lefts, rights = self.rank_of, self.order_of, self.left_of, self.right_of
        limit = 1 << 62
        while True:
            if ranks.get(left << 32 | right, limit) < limit:
                return False
            first, second = order[left], order[right]
            if first > second:
                if lefts[left] == left:
                    return True
                left, limit = rights[left], first
            else:
                if rights[right] == right:
                    return True
                right, limit = lefts[right], second + 1

    def backtrack(self, word: str) -> list[int]:
        """The tokens of a word (a string of symbols)."""
        longest, length, fits, n = self.matches.iter_long, self.length, self.fits, len(word)
        able = bytearray(b"\1") * (n + 1)
        out, at, token = [], 0, next(longest(word, 0))[1]
        while True:
            end = at + length[token]
            if able[end] and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(word, at))[1]
            elif (shorter := self.shorter[token]) is not None:
                token = shorter
            else:
                able[at] = 0
                token = out.pop()
                at -= length[token]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, joined, and the count of each word's."""
        special = [self.special.get(w) for w in words] if self.special else [None] * len(words)
        cut = [k for k, s in enumerate(special) if s is None and words[k]]
        own = [words[k].decode("latin-1") for k in cut]
        own = [w[:-1] + chr(256 + ord(w[-1])) for w in own]
        tokens = np.fromiter((i for _, i in self.matches.iter_long("".join(own))), np.int64)
        ends = np.cumsum(self.size[tokens])
        marks = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        if len(marks) and (not len(ends) or ends[-1] != marks[-1]):
            raise ValueError("the vocabulary lacks a byte")
        last = np.searchsorted(ends, marks)  # the token that ends each word
        of_word = np.searchsorted(marks, ends)
        inner = np.flatnonzero(of_word[1:] == of_word[:-1])
        codes, which = np.unique(tokens[inner] << 32 | tokens[inner + 1], return_inverse=True)
        good = self.compatible(codes >> 32, codes & 0xFFFFFFFF)[which]
        wrong = set(of_word[inner[~good]].tolist())
        parts: list = [None] * len(words)
        for k, i in enumerate(special):
            if i is not None:
                parts[k] = [i]
        first = np.r_[0, last[:-1] + 1] if len(last) else last
        for j, k in enumerate(cut):
            parts[k] = self.backtrack(own[j]) if j in wrong else tokens[first[j] : last[j] + 1]
        counts = np.fromiter((0 if p is None else len(p) for p in parts), np.int64, len(parts))
        ids = [np.asarray(p, np.int32) for p in parts if p is not None]
        return np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32), counts


@functools.lru_cache(2)
def _encoder(source: bytes) -> Encoder:
    return Encoder(Vocabulary(source))


def round_trip(docs: DataFrame, source: bytes, text: str = "text") -> DataFrame:
    """docs without text, with ids (packed: four bytes an id, little-endian, as token files hold them) and decoded (UTF-8).

    source: what the tokenizers file holds (a vocabulary, a few MB, sent to all tasks). Encodes and decodes in one pass,
    without a shuffle.
    """
    docs = docs.drop("ids", "decoded")
    at, keep = docs.columns.index(text), [c for c in docs.columns if c != text]
    shared, names = docs.sparkSession.sparkContext.broadcast(source), [*docs.columns, "ids"]

    def run(batches):
        encoder = _encoder(shared.value)
        ids = (b.select([*keep, "ids"]) for b in _encoded(batches, encoder, at, names))
        for b in _decoded(ids, encoder.v, len(keep), [*keep, "ids", "decoded"]):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pack(b.column("ids")), parted(b.column("decoded"))], names=b.schema.names)

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("ids", BinaryType()), StructField("decoded", BinaryType())]))


def pack(ids: pa.ListArray) -> pa.Array:
    """Lists of ids as bytes, four an id, little-endian."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary())


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def parted(joined: pa.Array) -> pa.Array:
    """Without the space after the last token."""
    return pc.binary_slice(joined, 0, -1)


def op13_word_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    source = read_ranks(path or public_tokenizers.path("word_bpe_49k.json"))
    done = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), source)
    return done.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
