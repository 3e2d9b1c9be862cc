"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of rows of a hashed table, one for the word and one for each of its
prefixes. Filters of widths 1 to 3 slide over the words; of each filter the largest activation over the whole text is
kept (max pooling), and a logistic layer reads these. The table's first column starts at the log odds of its bucket in the
learning rows, drawn towards 0 by their standard error, so that a chance word says little; while training, a share of the words
isn't heard. The cut on the raw probability is calibrated for each language, which is guessed from the text's own words, and
the score is stretched so that the cut lies at 0.5.

Learning takes a bounded sample: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, by hash order, of at most
``LONGEST`` letters each and ``MOST_LETTERS`` in each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fold, with_results
from pulsegrid.llm.textcode import Words, cut, parts, prefix_hashes, word_hash, word_table

#: Bounds of the learning sample: documents of each class, letters of a document, letters of a class.
MOST_TOXIC, MOST_CLEAN, LONGEST, MOST_LETTERS = 1200, 2400, 200_000, 16_000_000
#: Labelled ids looked up for each that is taken.
SPARE = 2
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PREFIXES = range(3, 8)
LANG_BUCKETS = 1 << 16
EPOCHS, BATCH, RATE, SEED = 8, 48, 0.02, 7
#: Share of words unheard in a training step, weight decay, standard errors by which log odds are drawn towards 0, rate of the table.
DEAF, DECAY, SHRINK, EMBED_RATE = 0.2, 1e-4, 1.0, 0.01
#: Texts spread out as code points at a time.
PART = 100


@dataclass
class Net:
    table: np.ndarray  # (BUCKETS + 1, DIM) float32, the last row is 0 and stands for "no prefix"
    conv: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]  # for each width (FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    base: float
    langs: list[str] = field(default_factory=list)
    lang_table: np.ndarray | None = None  # (LANG_BUCKETS, languages) log probabilities
    cut: np.ndarray | None = None  # one for each language


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + prefixes) rows of the table, and each word's bucket for the language guess."""
    whole, pre = word_hash(w), prefix_hashes(w, PREFIXES)
    rows = np.concatenate([whole[:, None], pre], axis=1)
    ids = (rows & np.uint64(BUCKETS - 1)).astype(np.int32)
    ids[:, 1:][pre == 0] = BUCKETS
    return ids, (whole >> np.uint64(40)).astype(np.int64) & (LANG_BUCKETS - 1)


def features_in_parts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the table, language buckets, first word of each document); a few texts at a time are spread out as code points."""
    ids, lang, first = [], [], [np.zeros(1, np.int64)]
    for part in parts(texts, PART):
        w = cut(part, word_table())
        a, b = features(w)
        ids.append(a)
        lang.append(b.astype(np.int32))
        first.append(w.first_of_doc()[1:] + first[-1][-1])
    if not ids:
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(0, np.int32), first[0]
    return np.concatenate(ids), np.concatenate(lang), np.concatenate(first)


def embed(net: Net, ids: np.ndarray) -> np.ndarray:
    v = net.table[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        v = v + net.table[ids[:, j]]
    return v


def forward(net: Net, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pooled, places): of each document and filter the largest activation over the whole text, and the word at which its window
    begins (the first of equals). ``first``: offsets of the documents' words. Windows reach over the end of a text into zeros
    only. A text without a word has zeros, at place 0."""
    n, sizes = len(v), np.diff(first)
    has = sizes > 0
    starts, owner = first[:-1][has], np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(first[1:], sizes) - np.arange(n)  # words from here to the text's end
    pooled, places = [], []
    for wi, width in enumerate(WIDTHS):
        a = np.tile(net.bias[wi], (n, 1))
        for o in range(width):
            part = v[o:] @ net.conv[wi][o]
            a[: n - o] += part * (left[: n - o, None] > o) if o else part
        np.maximum(a, 0, out=a)
        top = np.zeros((len(sizes), FILTERS), a.dtype)
        at = np.zeros((len(sizes), FILTERS), np.int64)
        if len(starts):
            top[has] = np.maximum.reduceat(a, starts)
            where = np.where(a == top[owner], np.arange(n)[:, None], n)
            at[has] = np.minimum.reduceat(where, starts)
        pooled.append(top)
        places.append(at)
    return np.concatenate(pooled, axis=1), places


def raw(net: Net, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.log1p(x) @ net.out + net.base, -30, 30)))


def train(texts: list[str | None], toxic: np.ndarray, langs: list[str | None]) -> Net:
    """Fit on one part, calibrate the cuts on the other. Without both labels every score is the share of toxic rows."""
    rng = np.random.default_rng(SEED)
    y = toxic.astype(np.float32)
    n = len(y)
    ids, lang_ids, first = features_in_parts(texts)
    owner_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    tune = np.arange(n) % 4 == 3 if n >= 40 else np.zeros(n, bool)
    fit = np.flatnonzero(~tune)

    # Log odds of each bucket: documents that hold it, among toxic and among clean ones.
    pos, neg = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for d in fit:
        held = np.unique(ids[first[d] : first[d + 1]])
        (pos if y[d] else neg)[held] += 1
    p, q = max(1.0, float(y[fit].sum())), max(1.0, float((1 - y[fit]).sum()))
    odds = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (q + 1))
    unsure = SHRINK * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - unsure, 0)
    table = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    table[:, 0] = np.clip(odds, -1, 4)
    table[pos + neg == 0] = 0  # buckets never seen say nothing
    table[BUCKETS] = 0
    conv = [rng.normal(0, 0.3 / width, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    for c in conv:
        c[0, 0, :] = np.linspace(0.3, 1, FILTERS)
    net = Net(table, conv, [np.linspace(0, -4, FILTERS).astype(np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.05, np.float32), -1.0)

    names = sorted({x for x in langs if x is not None}) or ["und"]
    count = np.zeros((LANG_BUCKETS, len(names)))
    label = np.array([names.index(x) if x is not None else -1 for x in langs] or [0])
    for k in range(len(names)):
        count[:, k] = np.bincount(lang_ids[label[owner_of] == k], minlength=LANG_BUCKETS)
    net.langs = names
    net.lang_table = (np.log(count + 0.1) - np.log((count + 0.1).sum(axis=0))).astype(np.float32)
    net.cut = np.full(len(names), 0.5)
    if n == 0 or y.min() == y.max():
        net.out[:], share = 0, float(y.mean()) if n else 0.0
        net.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net

    params = [net.out, *net.conv, *net.bias]
    m, s = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    grown = np.zeros(BUCKETS + 1, np.float32)
    step = 0
    m0 = s0 = 0.0
    weight = np.where(y > 0, 0.5 / (y[fit].mean() + 1e-9), 0.5 / (1 - y[fit].mean() + 1e-9)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            sizes = first[pick + 1] - first[pick]
            at = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(at[-1]) + np.repeat(first[pick] - at[:-1], sizes)
            heard = (rng.random((len(rows), 1)) >= DEAF).astype(np.float32)
            v = embed(net, ids[rows]) * heard
            loss_grads, dv = gradients(net, v, at, y[pick], weight[pick])
            dv *= heard
            step += 1
            gb, *grads = loss_grads
            for k, gr in enumerate(grads):
                m[k] += 0.1 * (gr - m[k])
                s[k] += 0.01 * (gr * gr - s[k])
                params[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
            m0 += 0.1 * (gb - m0)
            s0 += 0.01 * (gb * gb - s0)
            net.base -= RATE * (m0 / (1 - 0.9**step)) / (np.sqrt(s0 / (1 - 0.99**step)) + 1e-7)
            hit = np.flatnonzero(np.abs(dv).sum(axis=1) > 0)
            if len(hit):
                for j in range(ids.shape[1]):
                    bucket = ids[rows[hit], j]
                    np.add.at(grown, bucket, (dv[hit] ** 2).mean(axis=1))
                    np.add.at(net.table, bucket, -EMBED_RATE * dv[hit] / (np.sqrt(grown[bucket])[:, None] + 1e-3))
                net.table[BUCKETS] = 0
    # Cuts: the best balance of misses and false alarms among clean rows, on the rows kept aside.
    check = np.flatnonzero(tune) if tune.any() and 0 < y[tune].sum() < tune.sum() else np.arange(n)
    p, guess = np.zeros(n), np.zeros(n, np.int64)
    for i in range(0, n, PART):
        at = first[i : i + PART + 1]
        p[i : i + PART], guess[i : i + PART] = predict_raw(net, ids[at[0] : at[-1]], lang_ids[at[0] : at[-1]], at - at[0])
    whole = best_cut(p[check], y[check])
    for k in range(len(names)):
        own = check[guess[check] == k]
        net.cut[k] = best_cut(p[own], y[own]) if min(y[own].sum(), (1 - y[own]).sum()) >= 8 else whole
    return net


def gradients(net: Net, v: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
    """([base, out, conv of each width, bias of each width], words) of the mean weighted log loss plus DECAY / 2 of the squares of out and conv."""
    x, places = forward(net, v, first)
    g = (raw(net, x) - y) * weight / len(y)
    dx = (g[:, None] * net.out / (1 + x)).reshape(len(y), len(WIDTHS), FILTERS)
    dv, dconv, dbias = np.zeros_like(v), [], []
    for wi, width in enumerate(WIDTHS):
        dc, db = DECAY * net.conv[wi], np.zeros_like(net.bias[wi])
        d, f = np.nonzero(x.reshape(len(y), len(WIDTHS), FILTERS)[:, wi] > 0)
        i, step = places[wi][d, f], dx[d, wi, f].astype(v.dtype)
        np.add.at(db, f, step)
        for o in range(width):
            ok = i + o < first[d + 1]
            np.add.at(dc[o].T, f[ok], step[ok, None] * v[i[ok] + o])
            np.add.at(dv, i[ok] + o, step[ok, None] * net.conv[wi][o].T[f[ok]])
        dconv.append(dc)
        dbias.append(db)
    return [float(g.sum()), np.log1p(x).T @ g + DECAY * net.out, *dconv, *dbias], dv


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap that gives the largest (hits - misses - 2 x false alarms); clean texts are to be left alone."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    gain = np.concatenate([[0], np.cumsum(np.where(y > 0, 1, -2))])
    can = np.concatenate([[True], p[1:] < p[:-1], [True]])
    k = int(np.argmax(np.where(can, gain, -np.inf)))
    high, low = (p[k - 1] if k else 1.0), (p[k] if k < len(p) else 0.0)
    return float(np.clip((high + low) / 2, 0.001, 0.999))


def predict_raw(net: Net, ids: np.ndarray, lang_ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(raw probability, guessed language) of each document."""
    x, _ = forward(net, embed(net, ids), first)
    votes = np.zeros((len(first) - 1, len(net.langs)))
    has = np.diff(first) > 0
    if has.any():
        votes[has] = np.add.reduceat(net.lang_table[lang_ids], first[:-1][has])
    return raw(net, x).astype(np.float64), votes.argmax(axis=1)


def scores(net: Net, texts: list[str | None]) -> np.ndarray:
    """0 to 1; 0.5 is the cut of the text's language."""
    p, guess = predict_raw(net, *features_in_parts(texts))
    c = net.cut[guess]
    return np.clip(np.where(p < c, 0.5 * p / c, 0.5 + 0.5 * (p - c) / (1 - c)), 0, 1)


def sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """text, toxic, lang of the learning rows: from each class the first by hash of the id, within the bounds. Of several
    rows of an id that of the smallest text hash is taken, before anything is collected. Documents without a text or of more than
    LONGEST letters are not learnt from (they are scored like any other)."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    texts = docs.where(F.length("text") <= LONGEST).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    # Ids of labelled documents only: the first by hash of each class, more than are taken, as some may have no text or too long a one.
    few = [own.where(c).orderBy(by_hash, "doc_id").limit(SPARE * k) for c, k in ((F.col("toxic") > 0, MOST_TOXIC), (F.col("toxic") <= 0, MOST_CLEAN))]
    chosen = few[0].unionByName(few[1]).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("x")).select("doc_id", "toxic", "x.text", "x.lang")
    by_class = Window.partitionBy("toxic").orderBy(by_hash, "doc_id")
    got = got.withColumns({"nth": F.row_number().over(by_class), "letters": F.sum(F.length("text")).over(by_class)})
    most = F.when(F.col("toxic") > 0, MOST_TOXIC).otherwise(MOST_CLEAN)
    got = got.where((F.col("nth") <= most) & (F.col("letters") <= MOST_LETTERS)).select("doc_id", "text", "lang", "toxic").toPandas()
    # By hash again, so that the parts don't depend on the order of arrival.
    return got.assign(key=pd.util.hash_array(got["doc_id"].to_numpy(np.int64))).sort_values(["key", "doc_id"]).reset_index(drop=True)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Net:
    s = sample(docs, labels)
    lang = [None if x is None or x != x else x for x in s["lang"]]
    return train([None if t is None or t != t else t for t in s["text"]], (s["toxic"] > 0).to_numpy(), lang)


def score_toxicity(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with two columns more: toxic_score (0 to 1) and toxic (score >= 0.5).

    Null, empty and wordless texts get the score of a text without evidence. Whole texts are read. Rows keep their
    number and columns; columns of the same names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # bounded by BUCKETS x DIM

    @F.pandas_udf("toxic_score double, toxic boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if t is None or t != t else t for t in b]
            p = np.concatenate([scores(held.value, part) for part in parts(texts, 2 * PART)] or [np.zeros(0)])
            yield pd.DataFrame({"toxic_score": p, "toxic": p >= 0.5})

    return with_results(docs, score(F.col("text").cast("string")), ["toxic_score", "toxic"])
