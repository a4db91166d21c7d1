"""Exact nearest neighbours, similarity graphs, query expansion, diffusion and reranking."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import discard, materialize
from ..ship import ship
from .relational import sample_rows
from .statistics import min_max
from .vectors import as_double, cosine, dot, l2_squared, norm

#: bytes of vectors, as doubles, in one block
BLOCK_BYTES = 32 << 20
#: where a block of queries has fewer, taking the corpus in once more costs more than the other core saves
LEAST_QUERIES = 250
#: queries that are scored in one go, so that the corpus is read once for all of them
LEAST_SCORED = 32
#: rankings compare scores in whole units of the 12th digit
SCALE = 1e12


def top_k(corpus: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vec: str = "embedding", metric: str = "cosine") -> DataFrame:
    """(key, score, rank) of the k best rows for one query vector; ties go by key.

    Cosine scores fall, squared L2 distances rise with the rank. Expressions only, so the scan, the
    scores and the partial top k stay in the JVM.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    if not len(query):
        raise ValueError("the query must be a non-empty vector")
    score = cosine(F.col(vec), q) if metric == "cosine" else l2_squared(F.col(vec), q)
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    best = corpus.select(F.col(key), score.alias("score")).orderBy(order, F.col(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, F.col(key))))


def with_metadata(hits: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits with their metadata; hits without a row are dropped after the top k, so fewer than k may remain."""
    return hits.join(metadata, key)


def _extent(df: DataFrame, vec: str) -> tuple[int, int]:
    """A table's rows, and the bytes that its vectors take as doubles."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.size(vec)) * 8).first()
    return rows, int(size or 0)


def _split(rows: int, size: int, least: int = 1) -> int:
    """The number of blocks of at most BLOCK_BYTES; `least` at least, no more than there are rows."""
    return max(1, -(-size // BLOCK_BYTES), min(least, rows))


def _blocks(df: DataFrame, vec: str, least: int = 1) -> int:
    return _split(*_extent(df, vec), least)


def _dealt(df: DataFrame, key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(blocks)).cast("int")


def _every(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _matrix(table: pa.Table, vec: str, kind: type | None = np.float64) -> np.ndarray:
    """A row for each vector, of their own type where `kind` is None."""
    lists = table.column(vec).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return (flat if kind is None else flat.astype(kind)).reshape(len(table), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def _chunks(rows: int, width: int, least: int = 1) -> Iterator[slice]:
    """Parts of a block of queries, whose scores against `width` rows take 16 MB at most, or 128 MB where that would be fewer than `least` queries."""
    step = max(1, (2 << 20) // max(1, width), min(least, (16 << 20) // max(1, width)))
    return (slice(at, at + step) for at in range(0, rows, step))


def _least(s: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores one that the k-th best reaches, and next to it: the k-th best of groups' best scores, where there are enough groups."""
    groups = s.shape[1] // 64
    if groups < 4 * k:
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    best = s[:, : groups * 64].reshape(len(s), groups, 64).max(axis=2)
    return np.partition(best, groups - k, axis=1)[:, groups - k]


def _best(left: pa.Table, right: pa.Table, k: int | None, include_self: bool, metric: str = "cosine") -> pa.Table:
    """(src, dst, score) of the k best rows of `right` (k, v) for each row of `left` (k, v, and a least score as `floor` or not), ties by key."""
    out = []
    if len(left) and len(right):
        ids, own = right.column("k").to_numpy(), left.column("k").to_numpy()
        q, c = _matrix(left, "v"), _matrix(right, "v")
        q, c = (_unit(q), _unit(c)) if metric == "cosine" else (q, c)
        floor = left.column("floor").to_numpy() if "floor" in left.column_names else None
        for part in _chunks(len(q), len(c)):
            s = q[part] @ c.T
            if metric == "l2":
                s = 2 * s - (q[part] ** 2).sum(axis=1)[:, None] - (c**2).sum(axis=1)[None, :]
                np.minimum(s, 0, out=s)
            if not include_self:
                for i in range(len(s)):
                    s[i, ids == own[part][i]] = -np.inf
            width = min(k or s.shape[1], s.shape[1])
            # all that may reach the k-th best once they are rounded, so that ties at the edge go by key as well
            edge = _least(s, width)
            if floor is not None:
                edge = np.maximum(edge, floor[part])
            edge = edge - (2e-12 + 1e-15 * np.abs(edge))
            row, col = np.nonzero(s >= edge[:, None])
            score = np.round(s[row, col], 12)
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            take = (place < width) & np.isfinite(score)
            if floor is not None:
                take &= score >= floor[part][row]
            row, col = row[take], col[take]
            out.append(pa.table({"src": own[part][row], "dst": ids[col], "score": score[take]}))
    return pa.concat_tables(out) if out else pa.table({"src": left.column("k").slice(0, 0), "dst": right.column("k").slice(0, 0), "score": pa.array([], pa.float64())})


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int | None, key: str = "vec_id", vec: str = "embedding", include_self: bool = True, metric: str = "cosine",
    corpus_key: str | None = None, corpus_vec: str | None = None,
) -> DataFrame:
    """(src, dst, score, rank): the k best corpus rows for every row of queries, or all of them where k is None; ties go by the corpus key.

    Cosine scores fall, squared L2 distances rise with the rank. `corpus_key` and `corpus_vec` are the corpus's columns where they
    have other names. Queries and corpus are dealt into blocks of at most BLOCK_BYTES, the larger side into as many as there are cores
    at least. A task multiplies one pair of blocks, each pair in a task of its own, and leaves k rows a query, which are ranked together. Nothing passes the driver.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    spark = queries.sparkSession
    ship(spark)
    corpus_key, corpus_vec = corpus_key or key, corpus_vec or vec
    (rows_q, size_q), (rows_c, size_c) = _extent(queries, vec), _extent(corpus, corpus_vec)
    cores = spark.sparkContext.defaultParallelism
    n_q, n_c = (_split(rows_q, size_q, cores if size_q >= size_c else 1), _split(rows_c, size_c, cores if size_q < size_c else 1))
    kinds = dict(queries.dtypes)[key], dict(corpus.dtypes)[corpus_key]

    schema = pa.schema({"src": to_arrow_type(queries.schema[key].dataType), "dst": to_arrow_type(corpus.schema[corpus_key].dataType), "score": pa.float64()})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for b in batches:
            for side, name in enumerate(("src", "dst")):
                some = b.filter(pc.equal(b.column("side"), side))
                if len(some):
                    sides[side].append(pa.RecordBatch.from_arrays([some.column(name), some.column("v")], ["k", "v"]))
        if all(sides):
            yield from _best(*map(pa.Table.from_batches, sides), k, include_self, metric).cast(schema).to_batches(1 << 16)

    kind = "array<float>" if {dict(queries.dtypes)[vec], dict(corpus.dtypes)[corpus_vec]} == {"array<float>"} else "array<double>"

    def sent(df: DataFrame, side: int, own: str, v: str, qb: Column, cb: Column) -> DataFrame:
        keys = [(F.col(own) if side == i else F.lit(None)).cast(kinds[i]).alias(name) for i, name in enumerate(("src", "dst"))]
        return df.withColumn("_qb", qb).withColumn("_cb", cb).select((F.col("_qb") * n_c + F.col("_cb")).cast("int").alias("task"), F.lit(side).alias("side"), *keys, F.col(v).cast(kind).alias("v"))

    parts = sent(queries, 0, key, vec, _dealt(queries, key, n_q), _every(n_c)).unionByName(sent(corpus, 1, corpus_key, corpus_vec, _every(n_q), _dealt(corpus, corpus_key, n_c)))
    found = parts.repartitionById(n_q * n_c, F.col("task")).mapInArrow(best, f"src {kinds[0]}, dst {kinds[1]}, score double")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    ranked = found.withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked if metric == "cosine" else ranked.withColumn("score", F.abs("score"))


class _Cells:
    """Pivots as unit vectors and, once they are known, each cell's rows and radius: a few thousand rows at most."""

    #: a bound that rounding to 12 digits can't cross: distances near 0 are off by a root of that
    SLACK = 1e-5

    def __init__(self, pivots: np.ndarray):
        self.pivots = _unit(pivots)
        self.rows = self.radius = np.zeros(len(pivots))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Euclidean distances of unit vectors to the pivots, a row for each vector."""
        squares = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """A flag for each vector and cell: the nearest cells until they hold k rows."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.rows > 0)

    def reached(self, d: np.ndarray, x: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """A flag for each vector and cell: whether some row of the cell may score at least `floor`.

        A row c of score s = xc is sqrt(|x|^2 + |c|^2 - 2s) away, |c| at most 1, and no row of a cell is nearer than the pivot's distance less the radius.
        """
        most = np.sqrt(np.maximum((x**2).sum(axis=1) + 1 - 2 * floor, 0)) + self.SLACK
        return (d - self.radius[None, :] <= most[:, None]) & (self.rows > 0)


def nearest_pruned(
    queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", include_self: bool = True, pivots: int = 0, most: float = 0.5, report: dict | None = None,
) -> DataFrame:
    """What `nearest` gives for cosines, comparing a query only with cells of the corpus that can hold one of its k best rows.

    The corpus's rows go to the nearest of some pivots (rows least by hash; the root of their number, 2,048 at most, where `pivots` is 0), and
    each cell has a radius. Every query is compared with its nearest cells that hold k rows together; its k-th score then
    bounds how far a better row can be, and by the triangle inequality which other cells can have one. Only those are joined. A cell of more
    than BLOCK_BYTES is cut, and so are the queries that come to it. Where more than the share `most` of all pairs is left after the
    first comparison, cells save nothing, and the block join of `nearest` gives the rows. `report` gets the numbers of pairs: all, compared.
    """
    spark = queries.sparkSession
    ship(spark)
    rows_c, size_c = _extent(corpus, vec)
    rows_q = queries.count()
    report = {} if report is None else report
    report |= {"pairs": rows_q * rows_c, "compared": 0}
    if not rows_c or not rows_q:
        return nearest(queries, corpus, k, key, vec, include_self)
    want = k if include_self else k + 1
    chosen = sample_rows(corpus.select(key, vec), key, pivots or max(1, min(2048, math.isqrt(rows_c)))).toPandas()
    cells = _Cells(np.stack([np.asarray(v, np.float64) for v in chosen[vec]]))
    kind, width = dict(corpus.dtypes)[key], size_c / rows_c
    shared = spark.sparkContext.broadcast(cells)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = shared.value.distances(_unit(_matrix(pa.Table.from_batches([b]), "v")))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(b)), cell])], ["k", "v", "cell", "away"])

    vectors = corpus.select(F.col(key).alias("k"), F.col(vec).cast("array<float>" if dict(corpus.dtypes)[vec] == "array<float>" else "array<double>").alias("v"))
    placed = materialize(vectors.mapInArrow(assigned, f"k {kind}, v {dict(vectors.dtypes)['v']}, cell int, away double"), "cells")
    cells.rows, cells.radius = np.zeros(len(cells.pivots), np.int64), np.zeros(len(cells.pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():  # a row for each pivot
        cells.rows[r.cell], cells.radius[r.cell] = r.n, r.away
    known = spark.sparkContext.broadcast(cells)

    def visits(second: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                x = _unit(_matrix(pa.Table.from_batches([b]), "v"))
                d = known.value.distances(x)
                at = known.value.first(d, want)
                floor = np.full(len(b), -np.inf)
                if second:
                    floor = b.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    floor[np.isnan(floor)] = -np.inf  # fewer than k rows so far: every cell counts
                    at = known.value.reached(d, x, floor) & ~at
                row, cell = np.nonzero(at)
                for part in range(0, len(row), 1 << 15):
                    row_, cell_ = pa.array(row[part : part + (1 << 15)]), cell[part : part + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([b.column("k").take(row_), b.column("v").take(row_), pa.array(cell_.astype(np.int32)), pa.array(floor).take(row_)], ["k", "v", "cell", "floor"])

        return run

    asked = queries.select(F.col(key).alias("k"), F.col(vec).alias("v"))
    visit = f"k {dict(queries.dtypes)[key]}, v {dict(queries.dtypes)[vec]}, cell int, floor double"

    def compared(visiting: DataFrame, came: dict[int, int]) -> DataFrame:
        """(src, dst, score) of visits, by cells cut into blocks of rows and of visits."""
        cuts = [(int(c), max(1, -(-int(cells.rows[c] * width) // BLOCK_BYTES)), max(1, -(-int(n * width) // BLOCK_BYTES))) for c, n in came.items()]
        table = spark.createDataFrame(cuts, "cell int, n_rows int, n_visits int")  # a row for each pivot at most
        report["compared"] += sum(int(cells.rows[c]) * n for c, n in came.items())
        one = placed.join(F.broadcast(table), "cell").select("cell", F.pmod(F.xxhash64(F.lit("row"), "k"), "n_rows").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("n_visits") - 1)).alias("vb"), "k", "v")
        two = visiting.join(F.broadcast(table), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows").cast("long") - 1)).alias("rb"), F.pmod(F.xxhash64(F.lit("visit"), "k"), "n_visits").cast("int").alias("vb"), "k", "v", "floor")
        by = ["cell", "rb", "vb"]
        return two.groupBy(*by).cogroup(one.groupBy(*by)).applyInArrow(lambda _, a, b: _best(a, b, k, include_self), f"src {dict(queries.dtypes)[key]}, dst {kind}, score double")

    def counts(visiting: DataFrame) -> dict[int, int]:
        return {r.cell: r["count"] for r in visiting.groupBy("cell").count().collect()}  # a row for each pivot at most

    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    near = asked.mapInArrow(visits(False), visit)
    first = materialize(compared(near, counts(near)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "pruned-first")
    floors = first.filter(F.col("rank") == k).select("src", F.col("score").alias("floor"))
    far = asked.join(floors, F.col("k") == F.col("src"), "left").select("k", "v", "floor").mapInArrow(visits(True), visit)
    came = counts(far.select("cell"))
    if report["compared"] + sum(int(cells.rows[c]) * n for c, n in came.items()) > most * rows_q * rows_c:
        report["compared"] += rows_q * rows_c
        discard(placed, first)
        return nearest(queries, corpus, k, key, vec, include_self)
    more = compared(far, came)
    every = first.select("src", "dst", "score").unionByName(more)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similarity_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, w): positive neighbour scores, added to their transpose, rows scaled to sum to 1."""
    up = edges.select("src", "dst", F.greatest(F.col("score"), F.lit(0.0)).alias("w"))
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = both.groupBy("src").agg(F.sum("w").alias("_t"))
    return both.join(total, "src").select("src", "dst", (F.col("w") / F.greatest(F.col("_t"), F.lit(1e-12))).alias("w"))


def diffuse(graph: DataFrame, seeds: DataFrame, own: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, score): own * score + (1 - own) * the graph's weighted scores of seed neighbours; seeds only.

    Seeds are a sparse matrix, a row for each value of `by` (a query) and a column for each id: the spread is its product with
    the graph, joined on the neighbour and summed by row and node.
    """
    seed = seeds.select(*by, F.col("id").alias("dst"), F.col("score").alias("_s"))
    spread = graph.join(seed, "dst").groupBy(*by, F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("_s")).alias("_g"))
    return seeds.join(spread, [*by, "id"], "left").select(*by, "id", (own * F.col("score") + (1 - own) * F.coalesce("_g", F.lit(0.0))).alias("score"))


def mean_vector(df: DataFrame, group: Sequence[str], vec: str, name: str = "vec") -> DataFrame:
    """Mean by place of each group's vectors: partial sums, never a list of a group's rows."""
    each = df.select(*group, F.posexplode(as_double(F.col(vec))).alias("_pos", "_x"))
    means = each.groupBy(*group, "_pos").agg(F.avg("_x").alias("_x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"])
    return means.groupBy(*group).agg(ordered.alias(name)) if group else means.agg(ordered.alias(name))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: what a function over an array takes from outside is made again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def normalized(vec: Column, eps: float = 1e-8) -> Column:
    return _once(as_double(vec), lambda v: _once(norm(v) + F.lit(eps), lambda length: F.transform(v, lambda x: x / length)))


def expand_queries(queries: DataFrame, corpus: DataFrame, hits: DataFrame, top: int = 5, own: float = 0.6, key: str = "vec_id", vec: str = "embedding", corpus_key: str | None = None, corpus_vec: str | None = None) -> DataFrame:
    """(key, vec): for each query the L2-normalised own * query + (1 - own) * mean of its first `top` hits (src, dst, rank); the normalised query where it has none."""
    first = hits.filter(F.col("rank") <= top).select("src", "dst")
    found = first.join(corpus.select(F.col(corpus_key or key).alias("dst"), F.col(corpus_vec or vec).alias("_v")), "dst")
    means = mean_vector(found, ["src"], "_v", "_mean").select(F.col("src").alias("_src"), "_mean")
    mixed = F.zip_with(as_double(F.col(vec)), "_mean", lambda x, m: own * x + (1 - own) * m)
    both = queries.join(means, F.col(key) == F.col("_src"), "left")
    return both.select(F.col(key), normalized(F.coalesce(F.when(F.col("_mean").isNotNull(), mixed), as_double(F.col(vec)))).alias(vec))


def prototypes(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """(label, n, prototype): L2-normalised mean vector and size of each class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return mean_vector(df, [label], vec).join(sizes, label).select(label, "n", normalized(F.col("vec")).alias("prototype"))


def prototype_scores(protos: DataFrame, queries: DataFrame, label: str = "label", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(src, label, score, rank, margin): every query's cosine to each prototype; margin is a rank's lead on the next."""
    order = Window.partitionBy("src").orderBy("rank")
    scored = nearest(queries, protos, None, key, vec, corpus_key=label, corpus_vec="prototype")
    return scored.select("src", F.col("dst").alias(label), "score", "rank", (F.col("score") - F.lead("score").over(order)).alias("margin"))


def confidence(scores: DataFrame, least: float = 0.80, margin: float = 0.03, external: bool | Column = False, by: Sequence[str] = ()) -> DataFrame:
    """A row for each query (`by`): top1, gap to the second, low (either too small) and risk (low and from outside)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"))
    top = scores.withColumn("_n", F.lead("score").over(order)).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    gap = F.col("score") - F.coalesce("_n", F.lit(0.0))
    low = (F.col("score") < least) | (gap < margin)
    return top.select(*by, F.col("score").alias("top1"), gap.alias("gap"), low.alias("low"), (low & _column(external)).alias("risk"))


def _column(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rerank_weights(w: tuple[float, float, float], fallback: tuple[float, float, float] = (0.10, 0.80, 0.10)) -> tuple[float, float, float]:
    """Non-negative weights scaled to sum to 1; the fallback where they sum to nothing."""
    held = [max(0.0, float(x)) for x in w]
    total = sum(held)
    return tuple(x / total for x in held) if total > 1e-12 else fallback  # type: ignore[return-value]


def rerank(
    candidates: DataFrame, weights: tuple[float, float, float] = (0.15, 0.70, 0.15), group: Sequence[str] = (), low: bool | Column = False, top_label: object = None,
    top_score: float | Column = 0.0, top_margin: float | Column = 0.0, label: str = "label", adaptive: bool = True,
) -> DataFrame:
    """candidates (…, t1, t2, t3) with fused score and rank, within each `group` (a query).

    Tiers are min-max scaled over the pool (0.5 where constant). Adaptive weights: only
    tier 2 for unsure queries; else candidates of a convincing prototype's class lean on tier 1. What is known of a query comes as
    values, or as columns where it differs by group.
    """
    pool = Window.partitionBy(*group)
    scaled = candidates.withColumns({f"_n{i}": min_max(f"t{i}", pool, 0.5) for i in (1, 2, 3)})
    w1, w2, w3 = weights
    u1, u2 = min(0.35, w1 + 0.10), max(0.45, w2 - 0.08)
    unsure = F.coalesce(_column(low), F.lit(False)) if adaptive else F.lit(False)
    led = (F.coalesce(_column(top_score), F.lit(0.0)) >= 0.70) & (F.coalesce(_column(top_margin), F.lit(0.0)) >= 0.02) & F.coalesce(F.col(label) == _column(top_label), F.lit(False)) if adaptive and top_label is not None else F.lit(False)
    a, b, c = (F.when(unsure, x).when(led, y).otherwise(z) for x, y, z in ((0.0, u1, w1), (1.0, u2, w2), (0.0, max(0.10, 1 - u1 - u2), w3)))
    fused = scaled.withColumn("fused", a * F.col("_n1") + b * F.col("_n2") + c * F.col("_n3")).drop("_n1", "_n2", "_n3")
    order = Window.partitionBy(*group).orderBy(F.desc("fused"), F.desc("t2"), "id")
    return fused.withColumn("rank", F.row_number().over(order))


def part_adjust(items: DataFrame, query_parts: DataFrame, corpus_parts: DataFrame, weights: dict[str, float], base: float = 0.7, by: Sequence[str] = ()) -> DataFrame:
    """(by…, id, score): base * score + (1 - base) / (1 + weighted sum of distances between named parts).

    query_parts has (by…, part, vec), corpus_parts (id, part, vec); parts that one side lacks count nothing.
    """
    w = query_parts.select(*by, "part", F.col("vec").alias("_q"))
    distance = F.sqrt(l2_squared(F.col("vec"), F.col("_q")))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    near = items.select(*by, "id").join(corpus_parts, "id").join(w, [*by, "part"])
    apart = near.groupBy(*by, "id").agg(F.sum(F.coalesce(weight[F.col("part")], F.lit(0.0)) * distance).alias("_d"))
    return items.join(apart, [*by, "id"], "left").select(*by, "id", (base * F.col("score") + (1 - base) / (1 + F.coalesce("_d", F.lit(0.0)))).alias("score"))


def fuse(blocks: dict[str, float]) -> Column:
    """Weighted vector columns, joined end to end."""
    return F.concat(*[_scaled(c, k) for c, k in blocks.items()])


def _scaled(column: str, k: float) -> Column:
    return F.transform(as_double(F.col(column)), lambda x: x * F.lit(k))


def boost(vec: Column, places: Sequence[int], weight: float) -> Column:
    """Named places times weight, where that is above 1."""
    if weight <= 1:
        return vec
    return F.transform(vec, lambda x, i: F.when(i.isin(list(places)), x * F.lit(weight)).otherwise(x))


def power_norm(vec: Column, eps: float = 1e-8) -> Column:
    return F.transform(as_double(vec), lambda x: F.signum(x) * F.sqrt(F.abs(x) + F.lit(eps)))


def root_norm(vec: Column, eps: float = 1e-8) -> Column:
    total = F.aggregate(as_double(vec), F.lit(0.0), lambda s, x: s + F.abs(x)) + F.lit(eps)
    return F.transform(as_double(vec), lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) / total))


def _before(values: np.ndarray, ids: np.ndarray, among: np.ndarray, among_ids: np.ndarray) -> np.ndarray:
    """How many of `among` come before each of `values`, both by (value, id); equal pairs don't come before each other."""
    n = len(values)
    second = np.concatenate([np.zeros(n, np.int8), np.ones(len(among), np.int8)])
    order = np.lexsort((second, np.concatenate([ids, among_ids]), np.concatenate([values, among])))
    counts = np.cumsum(second[order])
    out = np.empty(n, np.int64)
    first = order < n
    out[order[first]] = counts[first]
    return out


def _ranks(s: np.ndarray, rel: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ranks, from 1 and rising, of the rows `rel` among all by (score, id); scores are whole numbers.

    Where no other row has the score of one of them, all are sorted without ids, and those told by a quarter on top.
    """
    room = s.copy()
    room[rel] += 0.25
    room.sort()
    if -SCALE * 512 < room[0] and room[-1] < SCALE * 512 and not (room[1:] - room[:-1] == 0.25).any():
        return np.flatnonzero(np.floor(room) != room) + 1
    rest = np.ones(len(s), bool)
    rest[rel] = False
    values, among, among_ids = s[rel], s[rest], ids[rest]
    order = np.lexsort((ids[rel], values))
    values, own = values[order], ids[rel][order]
    held = np.sort(among)
    out = np.searchsorted(held, values, "left")
    tied = np.searchsorted(held, values, "right") > out
    if tied.any():
        same = np.isin(among, values[tied])
        out[tied] += _before(values[tied], own[tied], among[same], among_ids[same]) - np.searchsorted(np.sort(among[same]), values[tied], "left")
    return out + np.arange(1, len(out) + 1)


def _packed(counts: np.ndarray) -> bytes:
    """Counts that never fall: as bits, a one after as many zeros as each rises by, or as steps of one byte or eight where that is shorter; the first byte tells which."""
    n = len(counts)
    if n and counts[-1] < 7 * n:
        bits = np.zeros(int(counts[-1]) + n, bool)
        bits[counts + np.arange(n)] = True
        return b"\0" + np.packbits(bits).tobytes()
    steps = np.diff(counts, prepend=0)
    wide = len(steps) > 0 and steps.max() > 255
    return bytes([8 if wide else 1]) + steps.astype("<i8" if wide else "u1").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[0] == 0:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1", offset=1)))
        return at - np.arange(len(at))
    return np.cumsum(np.frombuffer(data, "<i8" if data[0] == 8 else "u1", offset=1), dtype=np.int64)


class _Held:
    """A matrix that a task reads again and again, a few MB of rows at a time: in a file of its own in Spark's local folder, which goes when the task ends."""

    STEP = 4 << 20

    def __init__(self):
        self.file = tempfile.NamedTemporaryFile(prefix="vectors", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        x = x if x.dtype in (np.float32, np.float64) else x.astype(np.float64)
        self.kind, self.width = x.dtype, x.shape[1]
        self.file.write(np.ascontiguousarray(x))
        self.rows += len(x)

    def clear(self) -> None:
        self.file.seek(0)
        self.rows = 0

    def parts(self) -> Iterator[np.ndarray]:
        """Rows as doubles, that hold until the next are asked for."""
        room = np.empty((max(1, min(self.rows, self.STEP // (8 * max(1, self.width)))), self.width), self.kind)
        self.file.seek(0)
        for at in range(0, self.rows, len(room)):
            part = room[: self.rows - at]
            if self.file.readinto(part) != part.nbytes:
                raise OSError("the file of a task's vectors was cut")
            yield part.astype(np.float64, copy=False)


def _coded(one: list[pa.RecordBatch], two: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of two sides as whole numbers, in the order of its values from 1; null is 0."""
    both = pa.chunked_array([b.column(name) for b in (*one, *two)]).combine_chunks()
    codes = pc.if_else(pc.is_valid(both), pc.rank(both, tiebreaker="dense", null_placement="at_end"), 0).to_numpy().astype(np.int64)
    return tuple(np.split(codes, [sum(map(len, one))]))  # type: ignore[return-value]


def _counted(forms: Sequence[Callable[[np.ndarray], np.ndarray]], schema: pa.Schema) -> Callable:
    """A task's work: a block of queries, then the corpus, block after block; for each query the ranks of the rows of its class, as their totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        names: list[pa.RecordBatch] = []
        held, formed = _Held(), _Held()
        for b in batches:  # queries first
            first = pc.equal(b.column("side"), 0)
            some, rest = b.filter(first), b.filter(pc.invert(first))
            if len(some):
                asked.append(some)
            if len(rest) and asked:
                held.add(_matrix(pa.Table.from_batches([rest]), "v", None))
                names.append(rest.select(["k", "l"]))
        if not asked or not held.rows:
            return
        src = pa.chunked_array([b.column("k") for b in asked]).combine_chunks()
        own, ids = _coded(asked, names, "k")
        mine, theirs = _coded(asked, names, "l")
        plain = _matrix(pa.Table.from_batches(asked), "v", None)
        del asked, names
        by_class, by_id = np.argsort(theirs, kind="stable"), np.argsort(ids, kind="stable")
        # where each query's class and its own row are in these
        (a, b), (c, d) = ([np.searchsorted(there[by], here, side) for side in ("left", "right")] for here, there, by in ((mine, theirs, by_class), (own, ids, by_id)))
        out = []
        for f, form in enumerate(forms or [None]):
            x = form(plain.astype(np.float64)) if form else plain.astype(np.float64)
            if form:
                formed.clear()
                for z in held.parts():
                    formed.add(form(z if z.dtype != held.kind else z.copy()))
            for part in _chunks(len(x), held.rows, LEAST_SCORED):
                scores, at = np.empty((len(x[part]), held.rows)), 0
                for z in (formed if form else held).parts():
                    s = x[part] @ z.T
                    s *= -SCALE
                    np.rint(s, out=s)
                    if np.isnan(s.sum()):
                        s[np.isnan(s)] = -np.inf  # the greatest, as in SQL
                    scores[:, at : at + len(z)] = s
                    at += len(z)
                for i, row in zip(range(part.start, part.stop), scores, strict=False):
                    rel = by_class[a[i] : b[i]]
                    if not len(rel) or not mine[i]:
                        continue
                    row[by_id[c[i] : d[i]]] = SCALE  # the query's own row has similarity -1
                    rank = _ranks(row, rel, ids)
                    out.append((f, src[i].as_py(), len(rank), int(rank[0]), float((np.arange(1, len(rank) + 1) / rank).sum())))
                if len(out) > 10_000:
                    yield _record(out, schema)
                    out = []
        if out:
            yield _record(out, schema)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def evaluate(queries: DataFrame, corpus: DataFrame, ks: Sequence[int] = (1, 5, 10), key: str = "vec_id", vec: str = "embedding", label: str = "label", forms: Sequence[Callable[[np.ndarray], np.ndarray]] = ()) -> DataFrame:
    """(src, hit_k…, ap) per query: whether a row of its class is among the first k, and average precision.

    The query's own row ranks with similarity -1 and counts as relevant; equal scores go by id; a query whose class is null or has no row in the corpus has
    zeros. A task has a block of queries and is sent the corpus, block after block, which it writes to a file of its own. It scores some queries at a time against all
    of it, so their ranks are whole in the task and only a row for each query leaves it. Queries are cut into blocks of at most BLOCK_BYTES and twice as many as there are cores, if
    they have LEAST_QUERIES each: what is shuffled is the corpus once for each block of queries. A task holds a block of queries, a few MB of vectors, the corpus's ids
    and classes as numbers, and 128 MB of scores, or those of one query where they are more.
    `forms` make other vectors of a matrix of the table's, row by row; each gets rows of its own, under its number in `form`.
    """
    spark = queries.sparkSession
    ship(spark)
    (rows_q, size_q), (rows_c, size_c) = _extent(queries, vec), _extent(corpus, vec)
    n_q, n_c = _split(rows_q, size_q, min(2 * spark.sparkContext.defaultParallelism, rows_q // LEAST_QUERIES)), _split(rows_c, size_c)

    def sent(df: DataFrame, task: Column, side: Column) -> DataFrame:
        return df.withColumn("task", task).select("task", side.alias("side"), F.col(key).alias("k"), F.col(vec).alias("v"), F.col(label).alias("l"))

    parts = sent(queries.filter(F.col(label).isNotNull()), _dealt(queries, key, n_q), F.lit(0)).unionByName(sent(corpus, _every(n_q), _dealt(corpus, key, n_c) + 1))
    kind, arrow = dict(queries.dtypes)[key], to_arrow_type(queries.schema[key].dataType)
    schema = pa.schema({"form": pa.int32(), "src": arrow, "n": pa.int64(), "best": pa.int64(), "total": pa.float64()})
    dealt = parts.repartitionById(n_q, F.col("task")).sortWithinPartitions("side")
    found = dealt.mapInArrow(_counted(forms, schema), f"form int, src {kind}, n long, best long, total double")
    per = found.groupBy("form", "src").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(max(len(forms), 1) - 1))).alias("form"), F.col(key).alias("src"))
    # a query without any relevant row has none of these
    hit = [F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks]
    return every.join(per, ["form", "src"], "left").select(*["form"] * bool(forms), "src", *hit, F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("ap"))


def summary(per_query: DataFrame, ks: Sequence[int] = (1, 5, 10), by: Sequence[str] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(*[F.avg(F.col(f"hit_{k}").cast("double")).alias(f"recall_at_{k}") for k in ks], F.avg("ap").alias("mean_ap"))


def tune(df: DataFrame, blocks: Sequence[str], grid: Sequence[Sequence[float]], ks: Sequence[int] = (1, 5, 10), key: str = "vec_id", label: str = "label", asked: Column | None = None) -> DataFrame:
    """(run, weights, recall_at_k…, mean_ap) for each weight tuple; the first strictly best run has best = true.

    `asked` holds for the rows that are queries, all where it is None. All runs are one pass: a task weighs the blocks of its vectors for each.
    """
    row = df.select(*[F.size(b) for b in blocks]).first()
    cuts = np.cumsum([0, *(row or [0] * len(blocks))])

    def form(w: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: _unit(x * np.repeat(np.asarray(w, np.float64), np.diff(cuts)))

    floats = {dict(df.dtypes)[b] for b in blocks} == {"array<float>"}  # which a task makes doubles of
    joined = F.concat(*[F.col(b) if floats else as_double(F.col(b)) for b in blocks]).alias("_v")
    whole = df.select(key, label, joined)
    queries = df.filter(asked).select(key, label, joined) if asked is not None else whole
    found = summary(evaluate(queries, whole, ks, key, "_v", label, [form(w) for w in grid]), ks, ["form"])
    named = df.sparkSession.createDataFrame([(i, ",".join(f"{x:g}" for x in w)) for i, w in enumerate(grid)], "run int, weights string")
    runs = named.join(found, F.col("run") == F.col("form"), "left").drop("form")
    every = Window.orderBy(F.desc(F.round("mean_ap", 12)), "run")  # a row per run
    return runs.withColumn("best", F.row_number().over(every) == 1)
