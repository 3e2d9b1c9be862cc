"""Texts of a batch as one array of code points, cut into words without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def letter_table() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def word_table() -> np.ndarray:
    """For each code point: a letter, digit or combining mark of a word?"""
    import unicodedata

    marks = np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)), bool, 0x110000)
    return marks | letter_table()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def parts(texts: list, most: int, chars: int = 1_000_000) -> Iterator[list]:
    """Runs of at most ``most`` texts and, unless a single text is longer, ``chars`` characters: what is spread out at a time stays bounded."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and (i - begin >= most or total + n > chars):
            yield texts[begin:i]
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield texts[begin:]


@dataclass
class Words:
    """All words of a batch, in order. ``doc`` ascends; a text without a word has none here."""

    code: np.ndarray  # uint32 code points of all lower-cased texts
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    n_docs: int

    def first_of_doc(self) -> np.ndarray:
        """n_docs + 1 offsets into the words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def cut(texts: list[str | None], table: np.ndarray) -> Words:
    """Maximal runs of code points that ``table`` allows, as words of the lower-cased texts. Null is empty."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(low) else np.zeros(0, np.int64)
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = table[code]
    edge = np.diff(inside)
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start
    doc = np.searchsorted(begins, start, "right") - 1
    return Words(code, start, length, doc, len(low))


def word_hash(w: Words) -> np.ndarray:
    """A 64-bit hash of each whole word."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(int(w.length.max()), BASE, np.uint64))
    total = int(w.length.sum())
    at = np.concatenate([[0], np.cumsum(w.length)[:-1]])
    inner = np.arange(total) - np.repeat(at, w.length)
    where = np.repeat(w.start, w.length) + inner
    return mixed(np.add.reduceat((w.code[where].astype(np.uint64) + np.uint64(1)) * power[inner], at))


def prefix_hashes(w: Words, sizes: range) -> np.ndarray:
    """(words, len(sizes)) hashes of each word's first k letters; a word shorter than k has 0 there."""
    out = np.zeros((len(w.start), len(sizes)), np.uint64)
    h = np.zeros(len(w.start), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(sizes[-1] if len(w.start) else 0):
            has = w.length > j
            h[has] += (w.code[w.start[has] + j].astype(np.uint64) + np.uint64(1)) * power
            power = power * BASE
            if j + 1 in sizes:
                out[has, j + 1 - sizes[0]] = mixed(h[has] ^ np.uint64(j + 1))
    return out
