"""Class prototypes over a stream of labelled vectors: running moments in keyed state, kept exactly once in a store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.retrieval import normalized
from ..operators.store import Store

MOMENTS = "id string, label {kind}, part int, n long, sums array<double>, squares array<double>"


def running_moments(vectors: DataFrame, label: str = "label", vec: str = "embedding", at: str = "at", lateness: str = "1 hour", parts: int = 8) -> DataFrame:
    """A stream of (id, label, part, n, sums, squares): after each micro-batch the moments so far of the classes that it changed.

    vectors is a stream with a time `at`; rows that come after the watermark, `lateness` behind the latest time, are left out. Each class is dealt
    over `parts` states, so that no task has a frequent class alone; a state is two vectors and a number. Null classes are a class of their own.
    """
    kind = dict(vectors.dtypes)[label]
    keyed = vectors.withWatermark(at, lateness).select(F.col(label).alias("label"), F.pmod(F.xxhash64(vec, at), F.lit(parts)).cast("int").alias("part"), F.col(vec).cast("array<double>").alias("v"), at)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, sums, squares = (state.get[0], *map(np.array, state.get[1:])) if state.exists else (0, 0.0, 0.0)
        for b in batches:
            x = np.stack(b["v"].to_numpy())
            n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            state.update((n, sums.tolist(), squares.tolist()))
            own = None if pd.isna(key[0]) else key[0]
            yield pd.DataFrame({"id": [f"{own}:{key[1]}"], "label": [own], "part": [key[1]], "n": [n], "sums": [sums.tolist()], "squares": [squares.tolist()]})

    return keyed.groupBy("label", "part").applyInPandasWithState(step, MOMENTS.format(kind=kind), "n long, sums array<double>, squares array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def keep(moments: DataFrame, store: Store, checkpoint: str, name: str = "prototypes") -> StreamingQuery:
    """Put the stream's moments into a store, a snapshot for each micro-batch, then stop when what has arrived is done.

    A micro-batch that is repeated after a failure is known by its number and changes nothing twice.
    """
    schema = moments.schema

    def put(batch: DataFrame, number: int) -> None:
        if not store.versions():
            store.create(batch.sparkSession.createDataFrame([], schema))
        store.change(batch, stream=(name, number))

    return moments.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prototypes(store: Store) -> DataFrame:
    """(label, n, prototype, variance) of the store's latest snapshot: unit mean vectors, and population variances by place."""
    rows = store.read()
    each = rows.select("label", F.posexplode(F.arrays_zip(F.col("sums").alias("s"), F.col("squares").alias("q"))).alias("pos", "x"))
    sums = each.groupBy("label", "pos").agg(F.sum("x.s").alias("s"), F.sum("x.q").alias("q"))
    sizes = rows.groupBy(F.col("label").alias("_l")).agg(F.sum("n").alias("n"))
    both = sums.join(sizes, F.col("label").eqNullSafe(F.col("_l")))
    places = both.select("label", "n", F.struct("pos", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("v")).alias("p"))
    wide = places.groupBy("label", "n").agg(F.array_sort(F.collect_list("p")).alias("p"))  # as wide as a vector
    return wide.select("label", "n", normalized(F.col("p.m")).alias("prototype"), F.transform("p.v", lambda v: F.greatest(v, F.lit(0.0))).alias("variance"))
