"""Least squares and ridge by tall-skinny QR.

Each task reduces its rows of (1, features, label) to one triangle, triangles are stacked and
reduced again on executors until few are left, and the last one is the train table as far as any
fit is concerned: it has at most as many rows as columns. Nothing is squared, so dependent columns
keep their rank: of all solutions the one of least norm is taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CELLS, FAN_IN = 2_000_000, 16
TRIANGLE = "part int, width int, r binary"


def _stacked(parts: Iterator[np.ndarray]) -> np.ndarray | None:
    """The triangle of all rows given, a chunk at a time."""
    held: np.ndarray | None = None
    for rows in parts:
        both = rows if held is None else np.vstack([held, rows])
        held = np.linalg.qr(both, mode="r") if len(both) > 1 else both
    return held


def _message(part: int, r: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([r.shape[1]], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())]
    return pa.record_batch(columns, ["part", "width", "r"])


def _reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[np.ndarray]:
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            place.append(part)
            if not batch.num_rows:
                continue
            flat = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            step = max(1, CHUNK_CELLS // (flat.shape[1] + 2))
            y = np.asarray(batch.column(1), dtype=np.float64)
            for i in range(0, len(flat), step):
                rows = flat[i : i + step]
                yield np.column_stack([np.ones(len(rows)), rows, y[i : i + step]])

    place: list[int] = []
    r = _stacked(parts())
    if r is not None:
        yield _message(place[0], r)


def _reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, part = None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(0)[i].as_py()
            r = np.frombuffer(batch.column(2)[i].as_py(), np.float64).reshape(-1, batch.column(1)[i].as_py())
            held = _stacked(iter([r] if held is None else [held, r]))
    if held is not None:
        yield _message(part, held)


def train_triangle(train: DataFrame, label: str) -> np.ndarray | None:
    """The triangle of (1, features, label) over all rows with a label; None without rows."""
    rows = train.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), F.spark_partition_id().alias("part"))
    rows = rows.where("y IS NOT NULL")
    parts = rows.select("part").distinct().count()
    triangles = rows.mapInArrow(_reduce_rows, TRIANGLE)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        triangles = triangles.repartition(parts, "part").mapInArrow(_reduce_triangles, TRIANGLE)
    found = [np.frombuffer(row.r, np.float64).reshape(-1, row.width) for row in triangles.collect()]
    return _stacked(iter(found))


@dataclass
class LeastSquares:
    """Weights and intercept."""

    weights: np.ndarray
    intercept: float

    @classmethod
    def fit(cls, train: DataFrame, label: str, alpha: float = 0.0) -> LeastSquares:
        """Squared error plus alpha times the squared weights; the intercept is free. Without
        rows it raises."""
        r = train_triangle(train, label)
        if r is None:
            raise ValueError("no train rows")
        # the first row carries the means, the rest is centred
        means = r[0, 1:] / r[0, 0]
        x, y = r[1:, 1:-1], r[1:, -1]
        if not len(x):
            weights = np.zeros(r.shape[1] - 2)
        elif alpha == 0:
            weights = np.linalg.lstsq(x, y, rcond=None)[0]
        elif len(x) < x.shape[1]:
            weights = x.T @ np.linalg.solve(x @ x.T + alpha * np.eye(len(x)), y)
        else:
            under = np.vstack([x, np.sqrt(alpha) * np.eye(x.shape[1])])
            weights = np.linalg.lstsq(under, np.concatenate([y, np.zeros(x.shape[1])]), rcond=None)[0]
        return cls(weights, float(means[-1] - means[:-1] @ weights))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``."""
        weights, intercept = self.weights, self.intercept

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            return pd.Series(np.vstack(features.to_numpy()) @ weights + intercept if len(features) else np.zeros(0))

        return df.withColumn("prediction", predict(vector_to_array("features")))
