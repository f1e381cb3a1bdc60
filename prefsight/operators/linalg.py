"""Distributed partial sums for the numeric operators.

``partial_sums`` runs a numpy function on every Arrow batch inside the tasks
(``mapInPandas``), keeps one running sum per partition, emits it in long form
(index, value) and lets a partial-aggregated ``groupBy`` add the partitions.
Only the summed array -- whose size the caller bounds (a gradient, a d x d
Gramian, one value per probe) -- reaches the driver.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest summed array we bring to the driver (2048 x 2048 doubles = 32 MB).
MAX_RESULT_ENTRIES = 2048 * 2048


def batch_matrix(series: pd.Series) -> np.ndarray:
    """Stack an Arrow list column into an (n, d) float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def partial_sums(df: DataFrame, vec_col: str, shape, fn: Callable[[np.ndarray, pd.DataFrame], np.ndarray],
                 extra_cols=()) -> np.ndarray:
    """Sum ``fn(X_batch, batch)`` over every row batch of ``df``."""
    shape = tuple(int(s) for s in np.atleast_1d(shape))
    size = int(np.prod(shape))
    if size > MAX_RESULT_ENTRIES:
        raise ValueError(f"result of {size} entries exceeds the driver bound {MAX_RESULT_ENTRIES}")

    def partition_sum(batches):
        acc = np.zeros(shape)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            acc += fn(batch_matrix(pdf[vec_col]), pdf)
        return acc.ravel()

    src = df.select(vec_col, *extra_cols)

    def run(batches):
        flat = partition_sum(batches)
        nz = np.nonzero(flat)[0]
        yield pd.DataFrame({"k": nz.astype(np.int64), "v": flat[nz]})

    rows = (src.mapInPandas(run, "k long, v double")
            .groupBy("k").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["v"]
    return out.reshape(shape)


def sigmoid_np(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * m))


def softplus_neg_np(m: np.ndarray) -> np.ndarray:
    return np.maximum(-m, 0.0) + np.log1p(np.exp(-np.abs(m)))
