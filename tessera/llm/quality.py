"""Operator 1: document quality by ordinal regression on graded ratings.

Ratings are graded from ``labels``: 0 for low quality, 1 for sound but toxic
text, 2 for sound and clean text.  The model (see ``ordinal``) gives every
document its expected grade and the tail probability P(grade >= ``SELECT_GRADE``);
documents with a tail of at least ``SELECT_TAIL`` are selected.

Cases: null, empty and blank texts get expected grade 0, tail 0 and aren't
selected; a null doc_id is kept as null; rows that repeat a document give equal
rows; without ratings, or with ratings of one grade only, everything with a
text is selected with tail 1; ratings of unknown documents and null ratings are
ignored; of two ratings of a document the higher counts; an empty table gives an
empty result; very long texts are read whole; a tail equal to ``SELECT_TAIL`` is
selected; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ordinal

SELECT_GRADE = 1
SELECT_TAIL = 0.3


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = ordinal.TRAIN_PER_GRADE) -> ordinal.Ordinal:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    texts, grades, weights = ordinal.sample(docs, labels, grade, per_grade)
    model = ordinal.Ordinal(pairs=False)
    return model.fit([ordinal.features(t) for t in texts], grades, weights)


def classify(docs: DataFrame, labels: DataFrame, model: ordinal.Ordinal | None = None) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) for every row of docs."""
    model = model or fit(docs, labels)

    def row(tails: np.ndarray, has: np.ndarray):
        if not tails.shape[1]:
            return np.zeros(len(has)), has.astype(float), has
        tail = np.where(has, tails[:, min(SELECT_GRADE, tails.shape[1]) - 1], 0.0)
        return np.where(has, tails.sum(axis=1), 0.0), tail, tail >= SELECT_TAIL

    return ordinal.scored(docs, model, {"expected_grade": "double", "tail_probability": "double", "selected": "boolean"}, row)
