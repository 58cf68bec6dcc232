"""Vector arithmetic as Column expressions, and Arrow kernels for bulk scans.

Distances are on the [0, 1] scale: 0 same direction, 0.5 orthogonal, 1 opposite.
Everything is computed in double from float storage and rounded in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimals that distances keep, so that the order of a sum can't be seen.
DECIMALS = 9


def doubles(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(u), doubles(v), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalise_distance(cosine_distance: Column) -> Column:
    """A raw cosine distance in [0, 2] to the [0, 1] scale."""
    return clamp01(cosine_distance / 2)


def cosine_distance(u: Column, v: Column) -> Column:
    """clamp((1 - cos) / 2); a zero vector is orthogonal to everything."""
    size = norm(u) * norm(v)
    return F.round(F.when(size == 0, F.lit(0.5)).otherwise(clamp01((1 - dot(u, v) / size) / 2)), DECIMALS)


def clustering_distance(u: Column, v: Column) -> Column:
    """max(0, 1 - dot) on unit vectors: the [0, 2] scale, not halved."""
    return F.round(F.greatest(F.lit(0.0), 1 - dot(u, v)), DECIMALS)


def bm25_distance(score: Column) -> Column:
    """1 / (1 + score): an order, not a cosine scale."""
    return 1 / (1 + score)


def vectors_equal(u: Column, v: Column) -> Column:
    """Same length and every element equal, without tolerance."""
    return (F.size(u) == F.size(v)) & F.forall(F.zip_with(u, v, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


def flat(column: pa.Array) -> np.ndarray:
    """A batch of equally long vectors as a matrix of doubles; anything else is an error."""
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in dimension")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a vector has a null element")
    m = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return m.reshape(len(column), -1) if len(column) else m.reshape(0, 0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def distances(m: np.ndarray, unit_probes: np.ndarray) -> np.ndarray:
    """Rows of m against unit probes."""
    return np.round(np.clip((1 - unit_rows(m) @ unit_probes.T) / 2, 0, 1), DECIMALS)


def with_distance(df: DataFrame, probe: list[float], vector: str = "embedding") -> DataFrame:
    """df with ``distance`` to one probe, by one matrix product per Arrow batch.

    Filters on df stay below this step and reach the scan.
    """
    unit = unit_rows(np.array([probe], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = flat(batch.column(vector))
            if len(m) and m.shape[1] != unit.shape[1]:
                raise ValueError(f"the probe has {unit.shape[1]} dimensions, the column {m.shape[1]}")
            d = distances(m, unit)[:, 0] if len(m) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], names=[*batch.schema.names, "distance"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("distance", T.DoubleType())]))
