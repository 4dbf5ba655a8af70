"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (never labels, language, source or key) are standardised and mapped to cosine
features that approximate a Gaussian kernel. Each partition of the labelled rows sums its part of the
normal equations, by fold; the sums over all but one fold give the scores that calibrate, the sum over
all gives the model. Calibration is isotonic regression on the scores of folds that a model hasn't seen.

Edge cases: a null text is empty; empty texts have zero statistics and a score like any other; without a
label every score is 0.5, with labels of one kind it is that kind. Null labels don't count; several labels
of one document are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import unit_hash
from .textkit import LOWER, blocks, span_hash, words

#: Kinds of bytes: upper, lower, digit, blank, line feed, stop marks, "!" or "?", bars, other ASCII marks, beyond ASCII.
_KIND = np.full(256, 9, np.uint8)
for _chars, _k in ((range(0x21, 0x7F), 8), (range(0x41, 0x5B), 0), (range(0x61, 0x7B), 1), (range(0x30, 0x3A), 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:'\"-()", 5), (b"!?", 6), (b"|/\\_=<>[]{}", 7), (range(0x80, 0x100), 9), (range(0x00, 0x09), 8)):
    _KIND[list(_chars)] = _k
STATISTICS = 24
FOLDS = 4


def _ratio(a, b):
    return a / np.maximum(b, 1)


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the most frequent one) by document."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[starts], counts)
    return np.bincount(d[starts], minlength=n), most


def block_statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at)
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    kinds = np.bincount(doc * 10 + _KIND[raw], minlength=n * 10).reshape(n, 10).astype(float)
    start, end, owner = words(raw, at)
    low = LOWER[raw]
    count = np.bincount(owner, minlength=n)
    length = end - start
    distinct, most = _repeats(owner, span_hash(low, start, end), n)
    upper = np.concatenate([[0], np.cumsum(_KIND[raw] == 0)])
    letters = np.concatenate([[0], np.cumsum((_KIND[raw] <= 1) | (_KIND[raw] == 9))])
    marks = np.concatenate([[0], np.cumsum((_KIND[raw] >= 6) & (_KIND[raw] <= 8))])
    all_upper = (upper[end] - upper[start] == letters[end] - letters[start]) & (letters[end] > letters[start]) & (length > 1)
    marked = marks[end] > marks[start]
    bare = letters[end] == letters[start]
    by = lambda x: np.bincount(owner, weights=x, minlength=n)
    mean = _ratio(by(length), count)
    spread = np.sqrt(np.maximum(_ratio(by(length.astype(float) ** 2), count) - mean**2, 0))
    pair = span_hash(low, start[:-1], end[1:]) if len(start) > 1 else np.zeros(0, np.uint64)
    same = owner[1:] == owner[:-1]
    pairs_distinct, _ = _repeats(owner[1:][same], pair[same], n)
    feed = np.flatnonzero(raw == 0x0A)
    bound = np.unique(np.concatenate([at, feed, feed + 1]))
    line_start, line_end = bound[:-1], bound[1:]
    solid = (line_end - line_start > 1) | (raw[np.minimum(line_start, len(raw) - 1)] != 0x0A) if len(raw) else np.zeros(0, bool)
    line_start, line_end = line_start[solid], line_end[solid]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    lines_distinct, _ = _repeats(line_doc, span_hash(low, line_start, line_end), n)
    total = np.maximum(size, 1)[:, None]
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), kinds / total, mean, spread, _ratio(distinct, np.sqrt(np.maximum(count, 1))), _ratio(distinct, count), _ratio(most, count),
            _ratio(by(all_upper), count), _ratio(by(marked), count), _ratio(by(bare), count), _ratio(pairs_distinct, np.maximum(count - 1, 1)) * (count > 1),
            np.log1p(lines), _ratio(lines_distinct, lines), np.log1p(_ratio(size, lines)),
        ]
    )


def statistics(text: Column) -> Column:
    """STATISTICS numbers of each whole text."""

    @arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        n = len(texts)
        out = np.zeros((n, STATISTICS))
        for i, j, raw, at in blocks(texts):
            out[i:j] = block_statistics(raw, at)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * STATISTICS), pa.array(out.reshape(-1)))

    return measured(text)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    sums, counts, places = [], [], []
    for xi, yi in zip(x[order].tolist(), y[order].tolist(), strict=True):
        s, c, p = yi, 1.0, xi
        while sums and sums[-1] * c >= s * counts[-1]:
            s, c, p = s + sums.pop(), c + counts.pop(), p + places.pop()
        sums.append(s)
        counts.append(c)
        places.append(p)
    counts = np.array(counts)
    return np.array(places) / counts, np.array(sums) / counts


@dataclass(frozen=True)
class QualityModel:
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    turn: np.ndarray | None = None
    phase: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.ones(len(x)), np.cos(z @ self.turn + self.phase) * np.sqrt(2 / len(self.phase))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hundredth follows the raw score, so ties on a step keep their order."""
        if self.weights is None:
            return np.full(len(x), self.prior)
        raw = self.features(x) @ self.weights
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATISTICS)


def fit(measured: DataFrame, labels: DataFrame, most_labels: int = 50_000, features: int = 384, ridge: float = 1e-3, width: float = 1.3, seed: int = 5) -> QualityModel:
    """measured: doc_id, stats; labels: doc_id, quality of the rows to learn from. At most about `most_labels`
    labels are used, a sample by a hash of the key (the bound is on its expectation); that bounds what is
    broadcast and what calibration gathers."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    total = own.count()
    if not total:
        return QualityModel(0.5)
    own = own.where(unit_hash("doc_id", F.lit(61)) < most_labels / total)
    rows = measured.join(F.broadcast(own), "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id", F.lit(67)), F.lit(FOLDS)).cast("int").alias("fold"))
    width_all = [F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(STATISTICS)] + [F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(STATISTICS)]
    shape = rows.agg(F.count("*").alias("n"), F.avg("y").alias("prior"), *width_all).first()
    if not shape["n"] or shape["prior"] in (0.0, 1.0):
        return QualityModel(0.5 if not shape["n"] else shape["prior"])
    mean, scale = (np.array([shape[f"{k}{i}"] for i in range(STATISTICS)]) for k in "ms")
    rng = np.random.default_rng(seed)
    draft = QualityModel(shape["prior"], mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(STATISTICS, features)) / (width * np.sqrt(STATISTICS)), rng.uniform(0, 2 * np.pi, features))

    def equations(batches):
        a, b = {}, {}
        for batch in batches:
            z, y, fold = draft.features(_rows(batch.column(0))), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for k in np.unique(fold):
                at = fold == k
                a[k] = a.get(k, 0) + z[at].T @ z[at]
                b[k] = b.get(k, 0) + z[at].T @ y[at]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int32()), pa.array([v.tobytes() for v in a.values()]), pa.array([b[k].tobytes() for k in a])], names=["fold", "a", "b"])

    # The sample is bounded, so a few partitions hold it; each sends one matrix for each fold it has.
    parts = rows.repartition(FOLDS, "fold").mapInArrow(equations, "fold int, a binary, b binary").collect()
    size = features + 1
    a = {k: sum(np.frombuffer(p["a"]).reshape(size, size) for p in parts if p["fold"] == k) for k in {p["fold"] for p in parts}}
    b = {k: sum(np.frombuffer(p["b"]) for p in parts if p["fold"] == k) for k in a}

    def solve(without=None):
        left, right = sum(v for k, v in a.items() if k != without), sum(v for k, v in b.items() if k != without)
        return np.linalg.solve(left + ridge * shape["n"] / features * np.diag([1e-6] + [1.0] * features), right)

    final = solve()
    apart = {k: solve(k) if len(a) > 1 else final for k in a}

    def unseen(batches):
        for batch in batches:
            z, fold = draft.features(_rows(batch.column(0))), np.asarray(batch.column(2))
            raw = np.zeros(len(fold))
            for k in np.unique(fold):
                raw[fold == k] = z[fold == k] @ apart[k]
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column(1)], names=["raw", "y"])

    seen = rows.mapInArrow(unseen, "raw double, y double").orderBy("raw", "y").toPandas()
    return QualityModel(draft.prior, draft.mean, draft.scale, draft.turn, draft.phase, final, isotonic(seen["raw"].to_numpy(), seen["y"].to_numpy()))


def score(model: QualityModel, stats: Column) -> Column:
    @arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(_rows(column)))

    return scored(stats)
