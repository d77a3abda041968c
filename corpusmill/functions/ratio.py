"""difflib's ratio (SequenceMatcher with its defaults) of many texts to a block of others, for comparison forms (ASCII).

The ratio is twice the characters in matching blocks by those of both texts. difflib leaves characters that are frequent in
a second text of 200 or more out of its search and only extends blocks by them, so a block holds one of the rest or begins
both texts. Bounds on what blocks can hold, and the number itself, follow from that.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

#: Characters of a gram.
GRAM = 4
#: Slots for the hashed grams of a text; a collision only loosens a bound.
SLOTS = 18
#: Bits of both texts' places that `matched` holds at once; longer texts are left to difflib itself.
BITS = 1 << 28


def _grams(chars: np.ndarray, size: int) -> np.ndarray:
    """A slot for the characters from each place on, `size` of them; none for the last size - 1 places."""
    n = max(len(chars) - size + 1, 0)
    packed = chars[:n].astype(np.uint32)
    for i in range(1, size):
        packed |= chars[i : i + n].astype(np.uint32) << np.uint32(8 * i)
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)


class Searched:
    """A second text by what difflib searches it by: the places (bits) where each character, or gram, of it ends."""

    def __init__(self, text: str):
        self.text = text
        most = len(text) // 100 + 1 if len(text) >= 200 else len(text)
        self.at = dict.fromkeys((c for c, n in Counter(text).items() if n <= most), 0)
        for i, c in enumerate(text):
            if c in self.at:
                self.at[c] |= 1 << i
        #: All characters are searched by, so a long run can be begun at a gram of it.
        self.whole = len(self.at) == len(set(text))
        self.ends: dict[str, int] = {}
        for i in range(len(text) - GRAM + 1 if self.whole else 0):
            gram = text[i : i + GRAM]
            self.ends[gram] = self.ends.get(gram, 0) | 1 << i + GRAM - 1


class First:
    """A first text, with its grams made once for all second ones."""

    def __init__(self, text: str):
        self.text, self.spots = text, None

    @functools.cached_property
    def grams(self) -> list[str]:
        t = self.text
        return [t[i : i + GRAM] for i in range(len(t) - GRAM + 1)]

    def met(self, new: Searched) -> tuple[list[int], list[int]]:
        """The places where its characters are searched for in new, and those of new as bits."""
        found = sorted((i, bits) for c, bits in new.at.items() for i in self._spots(c))
        return [i for i, _ in found], [bits for _, bits in found]

    def _spots(self, char: str) -> list[int]:
        """The places of a character."""
        if self.spots is None:
            chars = np.frombuffer(self.text.encode(), np.uint8)
            self.order, self.until = np.argsort(chars, kind="stable"), np.cumsum(np.bincount(chars, minlength=128))
            self.spots = {}
        if char not in self.spots:
            c = ord(char)
            self.spots[char] = self.order[self.until[c - 1] : self.until[c]].tolist()
        return self.spots[char]

    def met_by_grams(self, new: Searched) -> tuple[list[int], list[int]]:
        """The same for the ends of grams."""
        found = [(i, bits) for i, bits in enumerate(map(new.ends.get, self.grams), GRAM - 1) if bits]
        return [i for i, _ in found], [bits for _, bits in found]


def _grown(old: str, at: dict[str, int], box: int, ahi: int, ends: list[tuple[int, int]], size: int) -> tuple[int, int, int]:
    """The first of the longest runs: one more character at a time, ends as bits, until none is left. ends isn't empty."""
    while True:
        i, bits = ends[0]
        ends = [(e + 1, more) for e, bits in ends if e + 1 < ahi and (more := (bits << 1) & at.get(old[e + 1], 0) & box)]
        if not ends:
            return i - size + 1, (bits & -bits).bit_length() - size, size
        size += 1


def matched(first: First, new: Searched, least: float = 0) -> int:
    """Characters in difflib's matching blocks of both texts; -1 as soon as they can't be `least`."""
    old, text, at = first.text, new.text, new.at
    left = min(len(old), len(text))
    if left < least:
        return -1
    if len(old) * len(text) > BITS:
        total = sum(m.size for m in SequenceMatcher(None, old, text).get_matching_blocks())
        return total if total >= least else -1
    by_gram, by_char = first.met_by_grams(new) if new.whole else None, None
    total, boxes = 0, [(left, 0, len(old), 0, len(text))] if left else []
    while boxes:
        # the largest first: it lowers the bound most, and the sum doesn't depend on the order
        most = max(boxes)
        boxes.remove(most)
        fits, alo, ahi, blo, bhi = most
        left -= fits
        box, ends, run = (1 << bhi) - (1 << blo), [], GRAM
        if by_gram and fits >= GRAM:
            places, bits = by_gram
            lo, hi, within = bisect_left(places, alo + GRAM - 1), bisect_left(places, ahi), box & -1 << blo + GRAM - 1
            ends = [(i, some) for i, b in zip(places[lo:hi], bits[lo:hi]) if (some := b & within)]
        if not ends:
            run, (places, bits) = 1, (by_char := by_char or first.met(new))
            lo, hi = bisect_left(places, alo), bisect_left(places, ahi)
            ends = [(i, some) for i, b in zip(places[lo:hi], bits[lo:hi]) if (some := b & box)]
        i, j, size = _grown(old, at, box, ahi, ends, run) if ends else (alo, blo, 0)
        while i > alo and j > blo and old[i - 1] == text[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and old[i + size] == text[j + size]:
            size += 1
        if size:
            total += size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if fits := min(part[1] - part[0], part[3] - part[2]):
                    left += fits
                    boxes.append((fits, *part))
        if total + left < least:
            return -1
    return total if total >= least else -1


class Block:
    """A block of second texts, prepared to bound their matches with any first text."""

    def __init__(self, texts: list[str]):
        self.texts = [Searched(t) for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.counts = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128) for t in texts], np.int32).reshape(-1, 128)
        self.chars = np.flatnonzero(self.counts.any(0))
        self.counts = np.ascontiguousarray(self.counts[:, self.chars])
        self._lay_out([i for i, t in enumerate(self.texts) if not t.whole])

    def _lay_out(self, own: list[int]) -> None:
        """The texts that difflib leaves characters out of, end to end, four null characters between."""
        gap = "\0" * 4
        flat = gap + "".join(self.texts[i].text + gap for i in own)
        chars = np.frombuffer(flat.encode(), np.uint8)
        self.of = np.repeat(np.array([0, *own], np.int64), [4, *(int(self.sizes[i]) + 4 for i in own)])
        marked, start = np.zeros(len(chars), bool), 4
        for i in own:
            # a block holds a character that is searched by, or begins the text
            marked[start] = True
            marked[start : start + self.sizes[i]] |= np.array([c in self.texts[i].at for c in self.texts[i].text])
            start += int(self.sizes[i]) + 4
        self.before = np.concatenate([[0], np.cumsum(marked)])
        self.places = np.flatnonzero(marked)
        # a gram with a null character is in no text: it gets the slot that is never set
        slots = {}
        for size in (3, 4):
            whole = np.lib.stride_tricks.sliding_window_view(chars != 0, size).all(1)
            slots[size] = np.where(whole, _grams(chars, size), 1 << SLOTS).astype(np.intp)
        self.four, self.three = slots[4], slots[3][self.places[:, None] - np.arange(3)]
        self.owner = self.of[self.places]
        self.laid = np.bincount(self.owner, minlength=len(self.texts)) > 0
        self.held = np.zeros((1 << SLOTS) + 1, bool)

    def shared(self, old: str) -> np.ndarray:
        """Characters that old has in common with each text, repeats counted: at least as many as difflib matches."""
        own = np.bincount(np.frombuffer(old.encode(), np.uint8), minlength=128)[self.chars].astype(np.int32)
        return np.minimum(self.counts, own).sum(1)

    def held_in_grams(self, old: str) -> np.ndarray:
        """At least as many characters as difflib matches, by the grams in common, where `laid`; elsewhere 0.

        A block of four characters and more lies in a run of grams that old has too; others hold up to three. A run of r
        marked places has parts of r blocks at most, which reach two places beyond it on each side at most.
        """
        chars = np.frombuffer(old.encode(), np.uint8)

        def holds(size: int, slots: np.ndarray) -> np.ndarray:
            own = _grams(chars, size).astype(np.intp)
            self.held[own] = True
            got = self.held[slots]
            self.held[own] = False
            return got

        four = holds(GRAM, self.four)
        edges = np.flatnonzero(four[1:] != four[:-1]) + 1
        starts, ends = edges[::2], edges[1::2] + GRAM - 1
        marks = self.before[ends] - self.before[starts]
        some = np.flatnonzero(marks)
        starts, ends, marks = starts[some], ends[some], marks[some]
        sizes = np.minimum(marks * (ends - starts), ends - starts + 4)
        within = four.copy()
        for i in range(1, GRAM):
            within[i:] |= four[:-i]
        alone = np.flatnonzero(~within[self.places])
        small = 2 + holds(3, self.three[alone]).any(1)
        at = np.concatenate([self.of[starts], self.owner[alone]])
        return np.bincount(at, weights=np.concatenate([sizes, small]), minlength=len(self.texts)).astype(np.int64)

    def most(self, old: str) -> np.ndarray:
        """The lesser of both."""
        out = self.shared(old)
        return np.where(self.laid, np.minimum(out, self.held_in_grams(old)), out) if self.laid.any() else out
