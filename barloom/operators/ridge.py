"""Ridge regression from sums: the model of `evaluation.ridge_forecast` without a table of its features.

Each batch gives its counts, sums and sums of products over the rows where both of a pair are known, about a centre of its
own; sums about one centre move to another exactly, so batches merge into matrices of features^2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def moments(x: np.ndarray) -> bytes:
    """Of rows x (NaN: unknown): a centre c, then for each pair of columns the rows n where both are known, and over these the sums of x_i - c_i and of (x_i - c_i)(x_j - c_j)."""
    known = ~np.isnan(x)
    c = np.where(known, x, 0.0).sum(0) / np.maximum(known.sum(0), 1)
    x, k = np.where(known, x - c, 0.0), known.astype(np.float64)
    return np.concatenate([c, (k.T @ k).ravel(), (x.T @ k).ravel(), (x.T @ x).ravel()]).tobytes()


def _parts(held: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(held)
    p = round((np.sqrt(1 + 12 * len(flat)) - 1) / 6)
    return flat[:p], flat[p:].reshape(3, p, p)


def _moved(c: np.ndarray, sums: np.ndarray, to: np.ndarray) -> np.ndarray:
    n, s, ss = sums
    d = c - to
    return np.stack([n, s + d[:, None] * n, ss + d[None, :] * s + d[:, None] * s.T + d[:, None] * d[None, :] * n])


def merged(held: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    c = sums = None
    for c2, sums2 in map(_parts, held):
        if sums is None:
            c, sums = c2.copy(), sums2.copy()
            continue
        c = np.where(np.diag(sums[0]) > 0, c, c2)
        sums = sums + _moved(c2, sums2, c)
    return None if sums is None else (c, sums)


def collected(parts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """All moments of the column s, merged by task, then in eight tasks, then here."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := merged(s for batch in batches for s in batch["s"].to_pylist()):
            yield pa.record_batch({"s": pa.array([np.concatenate([found[0], found[1].ravel()]).tobytes()], pa.binary())})

    last = parts.mapInArrow(merge, "s binary").repartition(8).mapInArrow(merge, "s binary")
    return merged(r.s for r in last.toLocalIterator())


def fitted(found: tuple[np.ndarray, np.ndarray] | None, penalty: float = 0.1) -> tuple[np.ndarray, np.ndarray, float | None]:
    """(means, weights, level): a prediction is level + sum of weight * (x - mean), an unknown x counting as its mean. The last column is the label, known in every row.

    As MLlib fits it: features and label standardised, the penalty divided by the label's deviation. A feature without
    known values, or that does not vary, has weight 0. Without rows the level is None.
    """
    if found is None:
        return np.empty(0), np.empty(0), None
    c, sums = found
    n = np.diag(sums[0])
    mean = c + np.diag(sums[1]) / np.maximum(n, 1)
    cov = _moved(c, sums, mean)[2] / n[-1]
    var = np.diag(cov)
    used = np.flatnonzero((var > 1e-24 * mean * mean) & (np.arange(len(c)) < len(c) - 1))
    weights, spread = np.zeros(len(c) - 1), np.sqrt(max(var[-1], 0.0))
    if len(used) and spread > 0:
        s = np.sqrt(var[used])
        corr = cov[np.ix_(used, used)] / s[:, None] / s
        weights[used] = np.linalg.solve(corr + penalty / spread * np.eye(len(used)), cov[used, -1] / s / spread) * spread / s
    return mean[:-1], weights, float(mean[-1])


def predicted(x: np.ndarray, means: np.ndarray, weights: np.ndarray, level: float | None) -> np.ndarray:
    if level is None:
        return np.full(len(x), np.nan)
    used = np.flatnonzero(weights)
    return level + np.nan_to_num(x[:, used] - means[used]) @ weights[used]
