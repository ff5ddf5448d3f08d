"""Principal components and k-means of one large unit: sufficient statistics by task, small models on the driver.

The grouped learners fit a unit in one task, which suits many units of bounded
size. A unit that outgrows a task is fitted here: every task sends back sums
whose size depends on the number of features and clusters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summed(df: DataFrame, vector: str, partial) -> np.ndarray:
    """The sum over all tasks of ``partial`` (a matrix of rows to an array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), dtype=np.float64)
                total = partial(x) if total is None else total + partial(x)
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "x"])

    rows = df.select(vector).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(rows.num_rows)
    out[rows["i"].to_numpy()] = rows["x"].to_numpy()
    return out


def principal_components(df: DataFrame, k: int, vector: str = "features") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings (features x k) and variances: from the sums and products of the rows.

    Meant for up to some thousands of features: a task holds features x features sums.
    """
    first = df.select(F.size(vector).alias("d")).first()
    if first is None:
        return np.empty(0), np.empty((0, k)), np.empty(0)
    d = first["d"]
    shift = _summed(df, vector, lambda x: np.r_[x.sum(axis=0), len(x)])
    mean, n = shift[:-1] / shift[-1], shift[-1]
    cov = _summed(df, vector, lambda x: (x - mean).T @ (x - mean)).reshape(d, d) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k]
    return mean, top * np.where(top.sum(axis=0) >= 0, 1, -1), values[::-1][:k]


def projected(df: DataFrame, mean: np.ndarray, loadings: np.ndarray, vector: str = "features", out: str = "scores") -> DataFrame:
    """Component scores of every row, as a native expression: the loadings are literals."""
    centred = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    score = lambda w: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.array(*[score(w) for w in loadings.T]))


def lloyd(df: DataFrame, centroids: np.ndarray, steps: int, vector: str = "features") -> np.ndarray:
    """Centroids after Lloyd steps; a task sends k sums and counts; an empty cluster keeps its centroid."""
    for _ in range(steps):
        def partial(x: np.ndarray, c: np.ndarray = centroids) -> np.ndarray:
            label = (((c * c).sum(axis=1)[None, :] - 2 * x @ c.T)).argmin(axis=1)
            one = np.eye(len(c))[label]
            return np.c_[one.T @ x, one.sum(axis=0)]

        total = _summed(df, vector, partial)
        if not len(total):
            return centroids
        total = total.reshape(len(centroids), -1)
        new = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centroids)
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids
