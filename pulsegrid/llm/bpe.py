"""Byte-level BPE encoding by a prefix-sharing trie traversal, and decoding.

The BPE encoding of a prefix is fixed by its last token and the prefix that this token leaves: a
token t may end the prefix behind last token s exactly if BPE would keep s and t apart when they
stand alone side by side. New distinct words of a batch go into a trie; a depth-first walk carries the
last-token state of every depth, so a prefix that many words share is encoded once. The cost is linear
in a word's length, also for very long runs without a break.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import with_results
from pulsegrid.llm.textcode import parts

# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of the encoded words that a worker remembers (a word counts PER_WORD more), and pairs whose test it remembers; both
#: start anew when full.
MOST_LETTERS, PER_WORD, MOST_PAIRS = 32_000_000, 30, 1_000_000
NEVER = 1 << 60


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file, with the tests that the traversal needs."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, signs = d["model"], byte_signs()
        raw = {t: bytes(signs[c] for c in t) for t in model["vocab"] if all(c in signs for c in t)}
        special = {x["content"]: x["id"] for x in d.get("added_tokens", [])}
        self.special = special
        self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw and t not in special}
        self.text = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = (self.ids[raw[x]] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(self.ids[self.text[a] + self.text[b]], (r, a, b))
        #: Every end of a token: its id, or -1 if the end itself is none.
        self.ends: dict[bytes, int] = {}
        for b in self.ids:
            for k in range(1, len(b) + 1):
                self.ends.setdefault(b[-k:], self.ids.get(b[-k:], -1))
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.specials = {s: str(i) for s, i in special.items()}
        self.words: dict[str, str] = dict(self.specials)
        self.letters = 0  # of all words remembered
        self.piece = {str(i): b for i, b in self.text.items()}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged into the next larger one) along the left (0) or right (1) edge of a token."""
        if (token, side) not in self.spines:
            out, until, t = [], NEVER, token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, *two = self.parts[t]
                t = two[side]
            self.spines[token, side] = out
        return self.spines[token, side]

    def apart(self, a: int, b: int) -> bool:
        """Does BPE leave a and b apart? A merge across the border happens if its rank comes before the merge that uses
        up its left part, and not after the one that uses up its right part (of equal ranks the leftmost goes first)."""
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            got = not any((r := self.rank.get((x, y))) is not None and r < x_until and r <= y_until for x, x_until in self.spine(a, 1) for y, y_until in self.spine(b, 0))
            self.pairs[key] = got
        return got

    def encode_words(self, words: list[str]) -> dict[str, str]:
        """{word: its ids, joined by commas}, by one depth-first walk over the trie of the words' bytes.

        The trie is held as its own depth-first order: sorted words, of which each shares with the one before the
        nodes of their common prefix. The walk goes back to that depth and keeps the states up to there."""
        keyed = sorted((word.encode("utf-8", "surrogatepass"), word) for word in words)
        out: dict[str, str] = {}
        ends, pairs, apart = self.ends.get, self.pairs.get, self.apart
        last, left = [-1], [0]  # of each depth: last token, and the depth that it leaves
        before = b""
        for w, word in keyed:
            shared, most = 0, min(len(before), len(w))
            if before[:most] == w[:most]:
                shared = most
            else:
                while before[shared] == w[shared]:
                    shared += 1
            del last[shared + 1 :], left[shared + 1 :]
            for depth in range(shared + 1, len(w) + 1):
                fits = begin = depth - 1
                token = ends(w[begin:depth])
                found = []
                while token is not None:
                    if token >= 0:
                        found.append((begin, token))
                    if not begin:
                        break
                    begin -= 1
                    token = ends(w[begin:depth])
                for fits, token in reversed(found):  # longest first; exactly one fits
                    if not fits:
                        break
                    ok = pairs(last[fits] << 32 | token)
                    if ok or ok is None and apart(last[fits], token):
                        break
                last.append(token)
                left.append(fits)
            ids, d = [], len(w)
            while d:
                ids.append(last[d])
                d = left[d]
            out[word] = ",".join(map(str, reversed(ids)))
            before = w
        return out

    def cut(self, text: str | None) -> list[str]:
        """The words of a text; special strings stay whole, and no word equals one, as every place of one is cut out first."""
        words = self.pattern.findall
        if not text or not any(x in text for x in self.special):
            return words(text or "")
        return [w for k, x in enumerate(self.split.split(text)) for w in ([x] if k % 2 else words(x))]

    def encode(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, joined by commas. Special strings are ids of their own; null is the empty text."""
        cuts, words = [self.cut(t) for t in texts], self.words
        every = set(chain.from_iterable(cuts))
        new = every.difference(words)
        size = sum(map(len, new)) + PER_WORD * len(new)
        if self.letters + size > MOST_LETTERS:
            words.clear()
            words.update(self.specials)
            new = every.difference(words)
            self.letters, size = 0, sum(map(len, new)) + PER_WORD * len(new)
        self.letters += size
        words.update(self.encode_words(list(new)))
        ids = words.__getitem__
        return [",".join(map(ids, ws)) for ws in cuts]

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.piece.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


@lru_cache(2)
def vocabulary(spec: str) -> Vocabulary:
    """One for each worker process, with its remembered words."""
    return Vocabulary(spec)


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver; executors get it by broadcast (its size is that of one vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenize(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 (of the ids joined by commas, of the decoded text), and with
    ``keep`` ids (array) and decoded (string). Null text encodes as the empty text; repeated rows stay; columns of
    the same names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(held.value)
        for b in batches:
            texts, rows = [None if t is None or t != t else t for t in b], []
            for part in parts(texts, 100):
                for ids in v.encode(part):
                    text = v.decode(ids)
                    rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *(([int(x) for x in ids.split(",")] if ids else [], text) if keep else ())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    return with_results(docs, run(F.col("text").cast("string")), [c.split()[0] for c in kind.split(", ")])
