"""Operator 2: toxicity severity by cumulative-link ordinal regression.

``labels`` says only whether a document is toxic.  Severity grades are made
from that: 0 for the others, and 1, 2 or 3 for toxic documents by the third
they fall in of the density of words that speak for toxicity (smoothed log-odds
of the labelled sample's other folds).  The model (see ``ordinal``) shares one weight vector of
words and word prefixes among the three ordered thresholds and gives expected
severity, P(grade >= 1), and the verdict.

Cases: null, empty and blank texts have severity 0 and aren't toxic; a null
doc_id is kept as null; rows that repeat a document give equal rows; without
labels, or with one class only, nothing is toxic; labels of unknown documents
and null labels are ignored, of two labels of a document the higher counts; an
empty table gives an empty result; very long texts are read whole; a probability
equal to ``DECISION`` is toxic; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ordinal

PREFIXES = (4, 6)
GRADES = 3
FOLDS = 5
#: Toxic words are few and telling; words that merely go with them in a small sample stay out.
SCREEN = 4.0
DECISION = 0.5
#: Labelled documents per class that the model is fitted on, at most.
TRAIN_PER_CLASS = 3_000


def severity(rows: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 1 to GRADES of toxic rows by density of telling features; 0 for the others.

    The odds that grade a row are counted on the other folds only.
    """
    fold = np.arange(len(rows)) % FOLDS
    counts = np.zeros((FOLDS, 2, ordinal.WIDTH))
    for (at, _), t, f in zip(rows, toxic, fold):
        counts[f, int(t), at] += 1
    size = np.array([np.bincount(toxic[fold == f], minlength=2) for f in range(FOLDS)])
    density = np.zeros(len(rows))
    for f in range(FOLDS):
        n = size.sum(axis=0) - size[f] + 1.0
        odds = np.log((counts[:, 1].sum(axis=0) - counts[f, 1] + 0.5) / n[1]) - np.log((counts[:, 0].sum(axis=0) - counts[f, 0] + 0.5) / n[0])
        odds = np.maximum(odds - 1.0, 0)
        odds[: ordinal.BINS * 8] = 0
        for i in np.flatnonzero(fold == f):
            at, value = rows[i]
            density[i] = (odds[at] * value).sum()
    grades = np.zeros(len(rows), np.int64)
    own = np.flatnonzero(toxic)
    if len(own):
        cuts = np.quantile(density[own], np.arange(1, GRADES) / GRADES)
        grades[own] = 1 + np.searchsorted(cuts, density[own], "left")
    return grades


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ordinal.Ordinal:
    texts, toxic, weights = ordinal.sample(docs, labels, F.when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 0), per_class)
    model = ordinal.Ordinal(PREFIXES, screen=SCREEN)
    rows = [ordinal.features(t, PREFIXES) for t in texts]
    return model.fit(rows, severity(rows, toxic), weights) if len(np.unique(toxic)) == 2 else model


def detect(docs: DataFrame, labels: DataFrame, model: ordinal.Ordinal | None = None) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, toxic) for every row of docs."""
    model = model or fit(docs, labels)

    def row(tails: np.ndarray, has: np.ndarray):
        if not tails.shape[1]:
            return np.zeros(len(has)), np.zeros(len(has)), np.zeros(len(has), bool)
        p = np.where(has, tails[:, 0], 0.0)
        return np.where(has, tails.sum(axis=1), 0.0), p, p >= DECISION

    return ordinal.scored(docs, model, {"expected_severity": "double", "p_toxic": "double", "toxic": "boolean"}, row)
