"""Language identification with spans: script ranges narrow the candidates of each word, per-word scores come from
hashed letter n-grams, and Viterbi with a switching penalty labels spans of mixed-language text.

Learning takes a bounded sample: about ``PER_LANG`` documents of each language, by hash,
and ``MOST`` in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, with_results
from pulsegrid.llm.textcode import Words, cut, letter_table, parts, word_hash

#: Expected documents of each language in the learning sample, and of the whole sample.
PER_LANG, MOST = 600, 6000
#: Texts of the sample spread out as code points at a time.
PART = 100
BUCKETS, NGRAMS, SWITCH, CLIP = 1 << 16, (1, 2, 3), 6.0, 8.0
#: Most words of a run that is labelled word by word.
BLOCK = 1024

# First and last code point of the letters of common scripts (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul jamo", 0x1100, 0x11FF),
    ("latin extended", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)


def script_of(code: np.ndarray) -> np.ndarray:
    """The number of each letter's script, from 1; 0 for other scripts."""
    low = np.array([a for _, a, _ in SCRIPTS])
    high = np.array([b for _, _, b in SCRIPTS])
    k = np.searchsorted(low, code, "right") - 1
    return np.where((k >= 0) & (code <= high[np.maximum(k, 0)]), k + 1, 0)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages) log probabilities of n-gram buckets, centred over the languages; the last row is 0
    scripts: np.ndarray  # (scripts + 1, languages) does the language use the script?


def gram_rows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, sizes of NGRAMS) buckets of the n-grams that begin at each place of the words with a mark before and behind (BUCKETS: none
    begins there), the first place of each word, and the bucket of each whole word."""
    n, total = len(w.start), int(w.length.sum())
    size = w.length + 2
    at = np.cumsum(size) - size
    # Words with their marks, side by side: letters are copied, marks stay.
    code = np.full(total + 2 * n, 1, np.uint64)
    body = np.ones(total + 2 * n, bool)
    body[at] = body[at + size - 1] = False
    step = np.ones(total, np.int64)
    first = np.cumsum(w.length) - w.length
    step[0] = w.start[0]
    step[first[1:]] = w.start[1:] - w.start[:-1] - w.length[:-1] + 1
    code[body] = w.code[np.cumsum(step)]
    ends = at + size
    out = np.full((len(code), len(NGRAMS)), BUCKETS, np.int32)
    h = np.zeros(len(code), np.uint64)
    ok = np.ones(len(code), bool)
    for k, j in enumerate(NGRAMS):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[: len(code) - j + 1] += code[j - 1 :]
        if j > 1:
            ok[ends - j + 1] = False  # too near to the word's end
        bucket = (((h + np.uint64(j)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32)
        out[:, k] = np.where(body if j == 1 else ok, bucket, BUCKETS)
    return out, at, (word_hash(w) >> np.uint64(48)).astype(np.int32)


def counts(texts: list[str | None], label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS, k) n-grams and (scripts, k) words of the texts, whose languages are ``label``; a few texts at a time."""
    count, share = np.zeros((BUCKETS, k)), np.zeros((len(SCRIPTS) + 1, k))
    done = 0
    for part in parts(texts, PART):
        w = cut(part, letter_table())
        of_part = label[done : done + len(part)]
        done += len(part)
        if len(w.start):
            rows, _, words = gram_rows(w)
            own = of_part[w.doc]
            place = np.repeat(own, w.length + 2)
            for bucket, of in ((words, own), *((r, place) for r in rows.T)):
                count += np.bincount(bucket.astype(np.int64) * k + of, minlength=(BUCKETS + 1) * k).reshape(-1, k)[:BUCKETS]
            share += np.bincount(script_of(w.code[w.start]) * k + own, minlength=(len(SCRIPTS) + 1) * k).reshape(-1, k)
    return count, share


def model(names: list[str], count: np.ndarray, share: np.ndarray) -> LangModel:
    """Smoothed log probabilities of the counted n-grams, and the scripts that hold over a hundredth of a language's words."""
    table = np.log((count + 0.5) / (count + 0.5).sum(axis=0))
    table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)
    return LangModel(names, np.concatenate([table, np.zeros((1, count.shape[1]), np.float32)]), share > 0.01 * share.sum(axis=0))


def fit(texts: list[str | None], langs: list[str]) -> LangModel:
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs], np.int64)
    return model(names, *counts(texts, label, max(1, len(names))))


def word_scores(m: LangModel, w: Words) -> np.ndarray:
    """(words, languages): how well each language explains each word; a script that a language doesn't use costs the clip."""
    if not len(w.start):
        return np.zeros((0, len(m.langs)), np.float32)
    rows, at, words = gram_rows(w)
    each = m.table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        each += m.table.take(rows[:, k], axis=0)
    score = np.add.reduceat(each, at) + m.table.take(words, axis=0)
    score -= score.max(axis=1, keepdims=True)
    fits = m.scripts[script_of(w.code[w.start])]
    none = ~fits.any(axis=1)
    score[~fits & ~none[:, None]] = -CLIP
    score[none] = 0  # a script that no language uses says nothing
    return np.maximum(score, -CLIP)


def steps(score: np.ndarray, begin: np.ndarray, sizes: np.ndarray, v: np.ndarray, switch: float, came: np.ndarray | None = None) -> np.ndarray:
    """The best value of each end state of each path: runs of ``sizes`` > 0 words from ``begin``, longest first, with start values ``v``
    (first word included; a middle axis of ``v`` holds several starts of one run). ``came`` gets the state before, word by word."""
    final = np.empty_like(v)
    live, longest = len(sizes), int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # runs with more than t words
    stay = np.arange(score.shape[1], dtype=np.int16)
    for t in range(1, longest + 1):
        now = int(active[t]) if t < longest else 0
        final[now:live] = v[now:]
        v, live = v[:now], now
        if not live:
            break
        at = begin[:live] + t
        add = score[at] if v.ndim == 2 else score[at][:, None]
        jump = v.max(axis=-1, keepdims=True) - switch
        if came is not None:
            came[at] = np.where(jump > v, v.argmax(axis=-1)[:, None], stay)
        v = np.maximum(jump, v) + add
    return final


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, over all documents at once: step t handles word t of every run that has one.

    Texts are cut into runs of at most BLOCK words. Of a text of several runs the best value from each state before a run to each
    at its end comes first, as a (max, +) matrix; the runs' matrices are combined one after another, which tells the state before
    and at the end of each run. Then all runs are labelled side by side, so the steps in Python are bounded by BLOCK and
    the runs of a text. Ties go to staying, then to the smaller language."""
    n, k = score.shape
    sizes = np.diff(first)
    path = np.zeros(n, np.int16)
    if not n:
        return path
    n_runs = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), n_runs)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    begin = first[doc] + nth * BLOCK
    size = np.minimum(BLOCK, first[doc + 1] - begin)
    start = score[begin].copy()
    end = np.full(len(doc), -1, np.int64)  # the state at the run's end, where it is known
    long = np.flatnonzero(n_runs > 1)
    if len(long):
        at = np.cumsum(n_runs) - n_runs
        opening = steps(score, begin[at[long]], size[at[long]], start[at[long]].copy(), switch)
        later = np.flatnonzero(nth > 0)
        later = later[np.argsort(-size[later], kind="stable")]
        leap = np.where(np.eye(k, dtype=bool), 0, -np.float32(switch))  # from the state before to the run's first word
        matrix = steps(score, begin[later], size[later], leap[None] + score[begin[later]][:, None], switch)
        row = np.zeros(len(doc), np.int64)
        row[later] = np.arange(len(later))
        for d, v in zip(long.tolist(), opening, strict=True):
            runs = range(int(at[d]) + 1, int(at[d] + n_runs[d]))
            back = []
            for r in runs:
                both = v[:, None] + matrix[row[r]]
                back.append(both.argmax(axis=0))
                v = both.max(axis=0)
            state = int(v.argmax())
            for r, b in zip(reversed(runs), reversed(back), strict=True):
                end[r] = state
                state = int(b[state])
                start[r] = leap[state] + score[begin[r]]
            end[runs[0] - 1] = state
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    came = np.zeros((n, k), np.int16)
    final = steps(score, begin, size, start[order], switch, came)
    last = np.where(end[order] >= 0, end[order], final.argmax(axis=1)).astype(np.int16)
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    state = np.zeros(len(order), np.int16)
    for t in range(longest - 1, -1, -1):
        live, begun = int(active[t]), int(active[t + 1]) if t + 1 < longest else 0
        state[begun:live] = last[begun:live]
        at = begin[:live] + t
        path[at] = state[:live]
        if t:
            state[:live] = came[at, state[:live]]
    return path


def label_texts(m: LangModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, spans) of each text: the language whose spans hold most letters (ties: the first by name),
    that share times the posterior of the language over its own words, and the number of spans. Without a letter: und, 0, 0."""
    w = cut(texts, letter_table())
    score, first = word_scores(m, w), w.first_of_doc()
    if not m.langs or not len(w.start):
        return ["und"] * w.n_docs, np.zeros(w.n_docs), np.zeros(w.n_docs, np.int64)
    path = viterbi(score, first)
    k = len(m.langs)
    letters = np.bincount(w.doc * k + path, weights=w.length, minlength=w.n_docs * k).reshape(-1, k)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    cuts = np.bincount(w.doc[1:], weights=((path[1:] != path[:-1]) & (w.doc[1:] == w.doc[:-1])), minlength=w.n_docs)
    own = path == best[w.doc]
    sums = np.stack([np.bincount(w.doc[own], weights=score[own, j], minlength=w.n_docs) for j in range(k)], axis=1)
    sure = 1 / np.exp(np.clip(sums - sums[np.arange(len(best)), best][:, None], -50, 50)).sum(axis=1)
    has = total > 0
    share = letters[np.arange(len(best)), best] / np.maximum(total, 1)
    return [m.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, np.clip(share * sure, 0, 1), 0), np.where(has, cuts + 1, 0).astype(np.int64)


def sample(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """(lang, text) of the learning rows, and the languages: rows with text and lang whose fold isn't 0, of each language about PER_LANG by
    hash and no more than that, repeats of a text under one id counting once."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0))
    own = own.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"), "text", F.col("lang").cast("string").alias("lang"))
    held = {r["lang"]: r["count"] for r in own.select("lang", "id", "hash").distinct().groupBy("lang").count().collect()}  # one row for each language
    if not held:
        return own.select("lang", "text"), []
    per = min(PER_LANG, MOST / len(held))
    share = F.create_map(*[x for k, n in held.items() for x in (F.lit(k), F.lit(min(1.0, per / n)))])
    spot = F.pmod(F.xxhash64("id", "hash"), F.lit(1 << 20))
    drawn = own.where(spot / float(1 << 20) < F.element_at(share, F.col("lang")))
    once = drawn.groupBy("lang", "id", "hash").agg(F.first("text").alias("text"))  # some PER_LANG rows of each language
    first = F.row_number().over(Window.partitionBy("lang").orderBy(spot, "id", "hash"))
    return once.withColumn("rank", first).where(F.col("rank") <= max(1, int(per))).select("lang", "text"), sorted(held)


def fit_languages(docs: DataFrame) -> LangModel:
    """Learn from the ``sample`` of ``docs``. Texts are counted by the executors; the driver gets at most BUCKETS sums of a language,
    however long the texts are. A language without a letter in any of its texts is none."""
    chosen, names = sample(docs)
    if not names:
        return fit([], [])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count, share = counts(b["text"].tolist(), np.array([names.index(x) for x in b["lang"]], np.int64), len(names))
            both = np.concatenate([count, share])
            at, lang = np.nonzero(both)
            yield pd.DataFrame({"at": at, "lang": lang, "n": both[at, lang]})

    got = chosen.mapInPandas(count, "at long, lang long, n double").groupBy("at", "lang").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(names)))
    both[got["at"], got["lang"]] = got["n"]
    heard = np.flatnonzero(both.any(axis=0))
    return model([names[i] for i in heard], both[:BUCKETS, heard], both[BUCKETS:, heard]) if len(heard) else fit([], [])


def detect_languages(docs: DataFrame, learned: LangModel) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1) and lang_spans. Null text or one without a letter is ``und`` with
    score 0 and no span. Whole texts are read; rows keep their number and columns, of the same name these are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(learned)  # bounded by BUCKETS x languages

    @F.pandas_udf("lang_pred string, lang_score double, lang_spans long")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if t is None or t != t else t for t in b]
            got = [label_texts(held.value, part) for part in parts(texts, 250)]
            yield pd.DataFrame({"lang_pred": [x for p in got for x in p[0]], "lang_score": np.concatenate([p[1] for p in got] or [np.zeros(0)]), "lang_spans": np.concatenate([p[2] for p in got] or [np.zeros(0, np.int64)])})

    return with_results(docs, label(F.col("text").cast("string")), ["lang_pred", "lang_score", "lang_spans"])
