"""Gating networks of a few left-out groups, fitted by passes over the rows where they lie.

The network is fitted by full-batch descent, so a step needs sums over rows only: a task adds its rows to every fold's gradient (but their own fold's), and the
driver moves a few weights a fold. Rows are packed once into blocks of plain numbers, which every pass reads. Thresholds of the fused training scores are order
statistics, found by passes that count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsegrid.learn import gates as G
from pulsegrid.learn.sums import Folds, finite, numbered, statistics

#: Rows of a block; parts into which a counting pass cuts a range, and the passes: together 2^-50 of the range is left.
BLOCK, PARTS, PASSES = 8192, 1024, 5


def packed(x: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(b): blocks of ``columns`` as doubles, dealt to all tasks that run at a time, however few files the rows come from."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            v = np.column_stack([r[c].to_numpy(zero_copy_only=False).astype(float) for c in columns])
            for i in range(0, len(v), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([v[i : i + BLOCK].tobytes()])], ["b"])

    return x.select(*columns).mapInArrow(task, "b binary").repartition(2 * x.sparkSession.sparkContext.defaultParallelism)


def over_blocks(blocks: DataFrame, width: int, run: Callable[[np.ndarray], np.ndarray], join: Callable = np.add) -> np.ndarray:
    """``run`` of every block, joined; a task sends one row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for r in batches:
            for b in r["b"]:
                s = run(np.frombuffer(b.as_buffer()).reshape(-1, width))
                total = s if total is None else join(total, s)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    empty = run(np.zeros((0, width)))
    for r in blocks.mapInArrow(task, "s binary").collect():
        empty = join(empty, np.frombuffer(r[0]).reshape(empty.shape))
    return empty


def fitted(blocks: DataFrame, s: Folds, d: int, k: int, net: G.GatingNet) -> list[G.GatingNet]:
    """The network of each fold. A block's columns: fold, label, ``d`` gate columns, ``k`` scores."""
    nets = []
    for f in range(len(s.values)):
        rng = np.random.default_rng(net.seed)
        one = G.GatingNet(**{n: getattr(net, n) for n in ("hidden", "rate", "epochs", "temperature", "decay", "alpha", "beta", "hard", "seed")})
        one.prepare = type(net.prepare)(median=s.median[f, :d], mean=s.mean[f, :d], std=s.std[f, :d])
        one.w1, one.b1 = rng.normal(0, 1 / np.sqrt(d), (d, net.hidden)), np.zeros(net.hidden)
        one.w2, one.b2 = rng.normal(0, 0.01, (net.hidden, k)), np.zeros(k)
        nets.append(one)
    for _ in range(net.epochs):

        def step(v: np.ndarray) -> np.ndarray:
            out = []
            for f, one in enumerate(nets):
                t = v[v[:, 0] != f]
                out.append(np.concatenate([g.ravel() for g in one.gradient(one.prepare(t[:, 2 : 2 + d]), t[:, 2 + d :], t[:, 1])]))
            return np.stack(out)

        sums = over_blocks(blocks, 2 + d + k, step)
        for f, one in enumerate(nets):
            one.move(sums[f], s.positives[f] + s.negatives[f])
    return nets


def thresholds(blocks: DataFrame, width: int, s: Folds, score: Callable[[int, np.ndarray], np.ndarray], span: tuple[float, float], min_spec: float) -> list[float]:
    """Per fold the threshold that ``folds.threshold`` takes of the scores of all other rows: the smallest positive score above the largest negative one that
    would be a false call too many. ``span`` holds all scores."""
    n = len(s.values)
    n0 = s.negatives.astype(int)
    allowed = [next(k for k in range(min(m, int((1 - min_spec) * m) + 2), -2, -1) if k < 0 or 1 - k / max(m, 1) >= min_spec) for m in n0]
    rank = np.array([m - 1 - k for m, k in zip(n0, allowed, strict=True)])  # from the smallest; under 0: none is too many
    wide = max(span[1] - span[0], 1e-300)
    low, high = np.full(n, span[0] - 1e-9 * wide), np.full(n, span[1] + 1e-9 * wide)
    step = np.arange(1, PARTS + 1) / PARTS
    for _ in range(PASSES):
        cut = low[:, None] + (high - low)[:, None] * step

        def count(v: np.ndarray, cut: np.ndarray = cut) -> np.ndarray:
            out = np.zeros((n, PARTS + 1))
            for f in range(n):
                t = v[(v[:, 0] != f) & (v[:, 1] == 0)]
                out[f] = np.bincount(np.searchsorted(cut[f], score(f, t)), minlength=PARTS + 1)
            return out

        below = np.cumsum(over_blocks(blocks, width, count), axis=1)[:, :PARTS]
        i = np.minimum((below <= rank[:, None]).sum(axis=1), PARTS - 1)
        low, high = np.where(i > 0, cut[np.arange(n), np.maximum(i - 1, 0)], low), cut[np.arange(n), i]

    def largest(v: np.ndarray) -> np.ndarray:
        out = np.full(n, -np.inf)
        for f in range(n):
            t = score(f, v[(v[:, 0] != f) & (v[:, 1] == 0)])
            out[f] = t[t <= high[f]].max(initial=-np.inf)
        return out

    bar = np.where(rank >= 0, over_blocks(blocks, width, largest, np.maximum), -np.inf)

    def smallest(v: np.ndarray) -> np.ndarray:
        out = np.full(n, np.inf)
        for f in range(n):
            t = score(f, v[(v[:, 0] != f) & (v[:, 1] == 1)])
            out[f] = t[t > bar[f]].min(initial=np.inf)
        return out

    return over_blocks(blocks, width, smallest, np.minimum).tolist()


def evaluate_nets(table: DataFrame, experts: Sequence[str], columns: Sequence[str], net: G.GatingNet, fold: str, min_spec: float, schema: str) -> DataFrame | None:
    """As ``folds.evaluate_moe`` for gating networks; None where some fold's others are of one class."""
    p, cols = [f"p_{m}" for m in experts], list(columns)
    d, k = len(cols), len(p)
    names = [*[f"_c{i}" for i in range(d)], *[f"_p{i}" for i in range(k)]]
    own = table.select(F.col(fold).alias("_group"), F.col("y").alias("_label"), *[F.col(c).alias(n) for c, n in zip([*cols, *p], names, strict=True)])
    x, values = numbered(own, names, "_label", "_group")
    blocks = packed(x.where("_y IS NOT NULL"), ["_fold", "_y", *names]).persist()
    try:
        s = statistics(x, names, values)
        if not ((s.positives > 0) & (s.negatives > 0)).all():
            return None
        nets = fitted(blocks, s, d, k, net)
        ends = x.where("_y IS NOT NULL").agg(F.min(F.least(*names[d:])), F.max(F.greatest(*names[d:]))).first()
        cuts = thresholds(blocks, 2 + d + k, s, lambda f, v: nets[f].predict(v[:, 2 : 2 + d], v[:, 2 + d :]), (ends[0], ends[1]), min_spec)
    finally:
        blocks.unpersist()
    keys = table.sparkSession.createDataFrame(list(enumerate(values)), T.StructType([T.StructField("_fold", T.IntegerType()), T.StructField("_id", table.schema[fold].dataType)]))
    mine = table.select("patient", "win_idx", "y", F.col(fold).alias("_f"), *[finite(c).alias(n) for c, n in zip([*cols, *p], names, strict=True)])
    mine = mine.join(keys, F.col("_f") == F.col("_id")).drop("_f", "_id")
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            of, v = r["_fold"].to_numpy(), np.column_stack([r[c].to_numpy(zero_copy_only=False).astype(float) for c in names])
            w, q, cut = np.zeros((len(v), k)), np.zeros(len(v)), np.array(cuts)[of]
            for f in np.unique(of):
                w[of == f] = nets[f].weights(v[of == f, :d])
                q[of == f] = (w[of == f] * v[of == f, d:]).sum(axis=1)
            made = [pa.array(q, from_pandas=True), pa.array(q >= cut), pa.array(np.where(np.isfinite(cut), cut, np.nan), from_pandas=True), *[pa.array(w[:, i]) for i in range(k)]]
            yield pa.RecordBatch.from_arrays([*[r[c].cast(target.field(c).type) for c in ("patient", "win_idx", "y")], *made], schema=target)

    return mine.mapInArrow(task, schema)
