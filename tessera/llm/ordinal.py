"""Cumulative-link (proportional odds) regression on hashed text features.

P(grade >= k | x) = sigmoid(w.x - theta_k) with one weight vector shared by all
ordered thresholds theta_1 < theta_2 < ... .  From it follow the expected grade
sum_k P(grade >= k) and the tail probability at any grade.

Features of a text, all hashed into ``DIM`` places: shares of its words, of
their prefixes and (optionally) of adjacent pairs, scaled to unit length, and
one-hot bins of whole-text statistics (capitals, symbols, digits, distinct and
repeated words, lengths).  Every text is read whole, a piece at a time.

Of labelled documents that tie for the last place of the sample the lesser
``doc_id`` is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import _BYTE, _IS_WORD, _pieces, _powers, in_batches, mix64

DIM = 1 << 18
BINS = 16
#: A feature's value is log(1 + SCALE * its share of the words); a text's values
#: are scaled to this length, so a large vocabulary by itself moves no score.
SCALE = 200.0
NORM = 10.0
#: Features whose presence tells no grades apart by so many standard deviations
#: have no weight: the more weak evidence counts, the lower.
SCREEN = 3.0
#: Ridge on the weights, against a mean log-likelihood.
L2 = 1e-4
#: Labelled documents per grade that the model is fitted on, at most.
TRAIN_PER_GRADE = 1_500

_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 symbol, 4 line end
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[10] = 4


def _hash_piece(raw: bytes, prefixes: tuple[int, ...], pairs: bool):
    """Feature hashes of one piece (a row per word) and statistics of it."""
    data = np.frombuffer(raw, np.uint8)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    kinds = np.bincount(_CLASS[data], minlength=5)
    if not len(start):
        return np.zeros((0, 1), np.uint64), kinds, len(data), 0, 0
    size = end - start
    first = np.cumsum(size) - size
    inside = lower[word]
    pos = np.arange(len(inside)) - np.repeat(first, size)
    value = _BYTE[inside] * _powers(int(size.max()))[pos]
    whole = np.add.reduceat(value, first)
    cols = [mix64(whole)]
    for k in prefixes:
        part = np.add.reduceat(np.where(pos < k, value, np.uint64(0)), first)
        cols.append(np.where(size > k, mix64(part + np.uint64(k)), cols[0]))
    repeats = int((whole[1:] == whole[:-1]).sum())
    if pairs:
        cols.append(np.r_[mix64(cols[0][:-1] * np.uint64(3) + cols[0][1:]), cols[0][-1:]])
    return np.stack(cols, axis=1), kinds, len(data), repeats, int(size.sum())


def _bin(x: float) -> int:
    return int(min(BINS - 1, max(0.0, x) * BINS))


def features(text: str | None, prefixes: tuple[int, ...] = (), pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of a text's features; an empty text has only its statistics."""
    parts, kinds, chars, repeats, letters = [], np.zeros(5, np.int64), 0, 0, 0
    for _, piece in _pieces([text or ""]):
        h, k, n, r, s = _hash_piece(piece.encode("utf-8", "surrogatepass"), prefixes, pairs)
        parts.append(h)
        kinds, chars, repeats, letters = kinds + k, chars + n, repeats + r, letters + s
    found = np.concatenate([p for p in parts if len(p)]) if any(map(len, parts)) else np.zeros((0, 1), np.uint64)
    words = len(found)
    distinct = len(np.unique(found[:, 0])) if words else 0
    stats = [
        kinds[1] / max(1, letters),
        3 * kinds[3] / max(1, chars),
        5 * kinds[2] / max(1, chars),
        distinct / max(1.0, words**0.85),
        2 * repeats / max(1, words),
        letters / max(1, words) / 16,
        np.log1p(words) / 12,
        8 * kinds[4] / max(1, words),
    ]
    fixed = np.array([i * BINS + _bin(x) for i, x in enumerate(stats)], np.int64)
    if not words:
        return fixed, np.ones(len(fixed), np.float32)
    place, count = np.unique(found.ravel() >> np.uint64(64 - 18), return_counts=True)
    value = np.log1p(count * (SCALE / words))
    value *= NORM / np.sqrt(value @ value)
    return np.r_[fixed, place.astype(np.int64) + BINS * len(stats)], np.r_[np.ones(len(fixed)), value].astype(np.float32)


WIDTH = DIM + BINS * 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(_log_sigmoid(x))


def _log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, -x)


class Sample:
    """Rows of (place, value), their grades and weights (which sum to 1)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray) -> None:
        self.at = np.concatenate([a for a, _ in rows])
        self.value = np.concatenate([v for _, v in rows]).astype(float)
        self.row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        self.grades, self.weight = grades, weight / weight.sum()

    def only(self, places: np.ndarray) -> None:
        own = places[self.at]
        self.at, self.value, self.row = self.at[own], self.value[own], self.row[own]

    def telling(self, top: int, screen: float) -> np.ndarray:
        """Places whose presence tells neighbouring grades, or those above from those below, apart; and the bins."""
        tells = np.zeros(WIDTH, bool)
        size = np.bincount(self.grades, minlength=top + 1)
        seen = np.array([np.bincount(self.at[self.grades[self.row] == g], minlength=WIDTH) for g in range(top + 1)])
        for k in range(1, top + 1):
            for low, high in ((slice(0, k), slice(k, None)), (slice(k - 1, k), slice(k, k + 1))):
                a, b, n, m = seen[low].sum(axis=0), seen[high].sum(axis=0), max(1, size[low].sum()), max(1, size[high].sum())
                both = (a + b) / (n + m)
                spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / m))
                tells |= (np.abs(a / n - b / m) >= screen * spread) & (a + b >= 4)
        tells[: BINS * 8] = True
        return tells


def thresholds(p: np.ndarray, width: int) -> np.ndarray:
    """theta from the parameters after the weights: theta_1 and the logs of the gaps."""
    return p[width] + np.r_[0.0, np.cumsum(np.exp(p[width + 1 :]))]


def objective(p: np.ndarray, sample: Sample, width: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge on the weights, and its gradient.

    With a and b the logits of P(grade >= g) and P(grade >= g + 1),
    log P(g) = log s(a) + log s(-b) + log(1 - exp(b - a)): no difference of
    nearly equal numbers, so rows far from their thresholds pull as they should.
    """
    w, theta = p[:width], thresholds(p, width)
    z = np.bincount(sample.row, weights=w[sample.at] * sample.value, minlength=len(sample.grades))
    edges = np.r_[-np.inf, theta, np.inf]
    a, b = z - edges[sample.grades], z - edges[sample.grades + 1]
    gap = a - b
    loss = -(sample.weight * (_log_sigmoid(a) + _log_sigmoid(-b) + np.log(-np.expm1(-gap)))).sum() + l2 / 2 * (w @ w)
    with np.errstate(over="ignore"):
        inside = 1 / np.expm1(gap)
    up, down = _sigmoid(-a), _sigmoid(b)
    g = np.empty_like(p)
    dz = -sample.weight * (up - down)
    g[:width] = np.bincount(sample.at, weights=dz[sample.row] * sample.value, minlength=width) + l2 * w
    d_edge = np.bincount(sample.grades, weights=sample.weight * (up + inside), minlength=len(edges))
    d_edge -= np.bincount(sample.grades + 1, weights=sample.weight * (down + inside), minlength=len(edges))
    tails = np.cumsum(d_edge[1:-1][::-1])[::-1]
    g[width] = tails[0]
    g[width + 1 :] = tails[1:] * np.exp(p[width + 1 :])
    return float(loss), g


def minimise(f, p: np.ndarray, steps: int = 300, tolerance: float = 1e-5, memory: int = 10) -> tuple[np.ndarray, int]:
    """L-BFGS with halving of steps; ends when no slope exceeds the tolerance."""
    value, g = f(p)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for t in range(steps):
        if np.abs(g).max() <= tolerance:
            return p, t
        q, used = g.copy(), []
        for s, y, r in reversed(pairs):
            used.append(r * (s @ q))
            q -= used[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.sqrt(q @ q)))
        for (s, y, r), alpha in zip(pairs, reversed(used)):
            q += (alpha - r * (y @ q)) * s
        slope, rate = -(g @ q), 1.0
        while True:
            nxt, slopes = f(p - rate * q)
            if nxt <= value + 1e-4 * rate * slope:
                break
            rate /= 2
            if rate < 1e-12:
                return p, t
        s, y = -rate * q, slopes - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        p, value, g = p + s, nxt, slopes
    return p, steps


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, prefixes: tuple[int, ...] = (), pairs: bool = False, l2: float = L2, screen: float = SCREEN) -> None:
        self.prefixes, self.pairs, self.l2, self.screen = prefixes, pairs, l2, screen
        self.w = np.zeros(WIDTH)
        self.theta = np.zeros(0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray | None = None) -> Ordinal:
        """Maximum likelihood with a ridge, to convergence, on the whole sample."""
        grades = np.asarray(grades, np.int64)
        top = int(grades.max(initial=0))
        if not top:
            return self
        sample = Sample(rows, grades, np.ones(len(grades)) if weight is None else np.asarray(weight, float))
        places = np.flatnonzero(sample.telling(top, self.screen))
        own = np.zeros(WIDTH, bool)
        own[places] = True
        sample.only(own)
        sample.at = np.searchsorted(places, sample.at)
        share = np.array([sample.weight[grades >= k].sum() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
        theta = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(top) * 1e-3)
        start = np.r_[np.zeros(len(places)), theta[0], np.log(np.diff(theta).clip(1e-3))]
        p, self.steps = minimise(lambda p: objective(p, sample, len(places), self.l2), start)
        self.w = np.zeros(WIDTH, np.float32)
        self.w[places] = p[: len(places)]
        self.theta = thresholds(p, len(places))
        return self

    def tails(self, texts: list) -> np.ndarray:
        """P(grade >= k), k = 1 ..., of every text."""
        z = np.zeros(len(texts))
        for i, text in enumerate(texts):
            at, value = features(text, self.prefixes, self.pairs)
            z[i] = float((self.w[at] * value).sum())
        return _sigmoid(z[:, None] - self.theta)


def sample(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(texts, grades, weights): at most ``per_grade`` documents of each grade, by hash.

    Weights undo the levelling, so that thresholds fit the labelled shares.  Of
    rows that disagree about a document the highest grade counts.
    """
    graded = labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null and grade >= 0")
    graded = graded.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    by = W.partitionBy("grade").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = graded.withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_grade).select("doc_id", "grade")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("doc_id", "grade", "text")
    found = sorted((r.grade, r.doc_id, r.text) for r in rows.toLocalIterator())
    total = {r.grade: r["count"] for r in graded.groupBy("grade").count().collect()}
    grades = np.array([g for g, _, _ in found], np.int64)
    seen = np.bincount(grades) if len(grades) else np.zeros(1)
    weights = np.array([total[g] / seen[g] for g in grades.tolist()])
    return [t for _, _, t in found], grades, weights


def scored(docs: DataFrame, model: Ordinal, columns: dict[str, str], row) -> DataFrame:
    """doc_id and what ``row`` makes of (tails, has text) for every row of docs."""

    def run(batches):
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            texts = batch["text"].tolist()
            out = row(model.tails(texts), np.array([bool(t and t.strip()) for t in texts]))
            yield pd.DataFrame({"doc_id": ids.to_numpy(), **dict(zip(columns, out))})

    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in columns.items())
    return in_batches(docs.select("doc_id", "text"), run, schema)
