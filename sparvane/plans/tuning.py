"""Grid search over fusion settings by retrieval quality."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..operators import fitting, retrieval, statistics


def grid(
    tiers: DataFrame, dims: Sequence[int] = (0, 256, 448), hu: Sequence[float] = (1.0, 1.5, 2.0, 3.0), first: Sequence[float] = (0.5, 1.0, 1.5, 2.0, 3.0),
    hu_places: Sequence[int] = (), ks: Sequence[int] = (1, 5, 10), asked: Column | None = None,
) -> DataFrame:
    """A row per run: pca_dim, hu_weight, tier1_weight, recall_at_k…, mean_ap and whether it is the best.

    tiers has (id, label, t1, t2, t3). Tiers are z-scored, the second reduced, the first
    boosted and weighted. Run 0 is the baseline: equal weights, nothing reduced or boosted. `asked` holds for the rows that are queries, all where it is None;
    settings are fitted on all rows.
    """
    scored = tiers
    for t in ("t1", "t2", "t3"):
        scored = statistics.zscore_vectors(scored, t)
    with shared.scratch(tiers.sparkSession):
        scored = shared.materialize(scored, "grid-scored")
        runs = [(0, 1.0, 1.0), *itertools.product(dims, hu, first)]
        reduced = {d: fitting.fit_pca(scored, "t2", d) for d in {r[0] for r in runs}}
        row = scored.select(F.size("t1").alias("one"), F.size("t2").alias("two")).first()
        one, two = row or (0, 0)

        def form(d: int, h: float, w: float):
            def fused(x: np.ndarray) -> np.ndarray:
                a, b = x[:, :one] * w, x[:, one : one + two]
                if h > 1:
                    a[:, [i for i in hu_places if i < one]] *= h
                v = np.concatenate([a, b if reduced[d] is None else reduced[d].apply(b), x[:, one + two :]], axis=1)
                return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)

            return fused

        whole = scored.select(F.col("id").alias("vec_id"), "label", F.concat(*[F.col(t).cast("array<double>") for t in ("t1", "t2", "t3")]).alias("embedding"))
        # every run in one pass: a task makes each run's vectors of its queries and the corpus
        found = retrieval.summary(retrieval.evaluate(whole if asked is None else whole.join(scored.filter(asked).select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), whole, ks, forms=[form(*r) for r in runs]), ks, ["form"]).collect()
    by = {r["form"]: tuple(r)[1:] for r in found}  # a row per run
    rows = [(i, *r, *by.get(i, (None,) * (len(ks) + 1))) for i, r in enumerate(runs)]
    kinds = "run int, pca_dim int, hu_weight double, tier1_weight double, " + ", ".join(f"recall_at_{k} double" for k in ks) + ", mean_ap double"
    out = tiers.sparkSession.createDataFrame([(i, int(d), float(h), float(w), *rest) for i, d, h, w, *rest in rows], kinds)
    order = Window.orderBy(F.desc(F.round("mean_ap", 12)), "run")  # a row per run
    return out.withColumn("best", F.row_number().over(order) == 1)


def component_association(df: DataFrame, attributes: Sequence[str], vec: str, dim: int = 16) -> DataFrame:
    """(attribute, max_abs, mean_abs): correlation of attributes with the first principal components of a vector column."""
    model = fitting.fit_pca(df, vec, dim)
    wide = fitting.apply_pca(df.select(*attributes, vec), vec, model, "_pc")
    n = len(model.axes) if model is not None else len(df.select(vec).first()[0])
    flat = wide.select(*attributes, *[F.get("_pc", i).alias(f"_pc{i}") for i in range(min(n, dim))])
    pairs = statistics.correlations(flat, attributes, [f"_pc{i}" for i in range(min(n, dim))])
    return pairs.groupBy(F.col("a").alias("attribute")).agg(F.max(F.abs("r")).alias("max_abs"), F.avg(F.abs("r")).alias("mean_abs"))
