"""Sums of wide arrays over all tasks, added by the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: numbers in one slice: what a task adds up at a time, and a row of the shuffle
SLICE = 1024


def add_up(df: DataFrame, make: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], width: int) -> np.ndarray:
    """The sum of what `make` gives of each task's rows: `width` numbers, or None for a task without any.

    Each task's array is cut into slices, which a shuffle brings together by their number. A slice is added in the order of the
    tasks, so reruns agree, and one copy of the sum comes to the driver, however many tasks there are.
    """

    ship(df.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = make(batches)
        if total is not None:
            part = TaskContext.get().partitionId()
            for first in range(0, width, 64 * SLICE):
                at = range(first, min(width, first + 64 * SLICE), SLICE)
                yield pd.DataFrame({"slice": [i // SLICE for i in at], "part": part, "v": [total[i : i + SLICE] for i in at]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for b in batches:
            done = []
            for i, v in zip(b["slice"], b["v"], strict=True):
                if i == at:
                    total += v
                else:
                    if at is not None:
                        done.append((at, total))
                    at, total = i, np.array(v, np.float64)
            if done:
                yield pd.DataFrame(done, columns=["slice", "v"])
        if at is not None:
            yield pd.DataFrame({"slice": [at], "v": [total]})

    # no more tasks than there are slices: rounds of a fit are many, and their sums often narrow
    slices = -(-width // SLICE)
    tasks = min(slices, max(df.sparkSession.sparkContext.defaultParallelism, slices // 8))
    parts = df.mapInPandas(cut, "slice int, part int, v array<double>").repartitionById(tasks, F.col("slice") % tasks)
    sums = parts.sortWithinPartitions("slice", "part").mapInPandas(add, "slice int, v array<double>")
    out = np.zeros(width)
    for r in sums.collect():
        out[r.slice * SLICE : r.slice * SLICE + len(r.v)] = r.v
    return out
