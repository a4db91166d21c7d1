"""Models fitted on pools of rows: PCA, codebooks, diagonal mixtures, part boxes, tier 2."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Speed
from ..functions import kernels as K
from ..ship import ship
from .relational import sample_rows
from .sums import add_up


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    axes: np.ndarray  # a row for each component

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes.T


def _signed(axes: np.ndarray) -> np.ndarray:
    """The largest loading of each axis positive, so that signs don't depend on the solver."""
    top = np.abs(axes).argmax(axis=1)
    return axes * np.where(axes[np.arange(len(axes)), top] < 0, -1, 1)[:, None]


def pca_of(x: np.ndarray, dim: int) -> Pca:
    """At most min(dim, rows, columns) components, by the smaller of the two Gram matrices."""
    x = np.asarray(x, np.float64)
    mean = x.mean(axis=0)
    c = x - mean
    dim = min(dim, *c.shape)
    if c.shape[0] < c.shape[1]:
        values, left = np.linalg.eigh(c @ c.T)
        order = np.argsort(-values)[:dim]
        axes = (left[:, order] / np.sqrt(np.maximum(values[order], 1e-12))).T @ c
    else:
        values, axes = np.linalg.eigh(c.T @ c)
        axes = axes[:, np.argsort(-values)[:dim]].T
    return Pca(mean, _signed(axes))


#: columns up to which the whole matrix of products is summed
FULL_WIDTH = 1024


def fit_pca(pool: DataFrame, vec: str, dim: int, rotate: bool = False) -> Pca | None:
    """PCA of a vector column from sums over all its rows, which executors add.

    Up to FULL_WIDTH columns (d) these are the d x d sums of products; wider columns go through `range_finder`, with d x dim sums. None where
    dim <= 0 or there is nothing to reduce; with `rotate`, a full turn where dim is no less than the width.
    """
    first = pool.select(vec).first()
    if first is None:
        return None
    d = len(first[0])
    if dim <= 0 or (dim >= d and not rotate):
        return None
    n, mean = _means(pool, vec, d)
    dim = min(dim, n, d)
    if dim >= d and not rotate:
        return None
    if d > FULL_WIDTH and 2 * (dim + 8) < d:
        return Pca(mean, _signed(range_finder(pool, vec, dim, n, mean)))

    def products(batches):
        g = None
        for b in batches:
            if len(b):
                x = _stacked(b, vec) - mean
                g = x.T @ x if g is None else g + x.T @ x
        return None if g is None else g.ravel()

    values, axes = np.linalg.eigh(add_up(pool.select(vec), products, d * d).reshape(d, d))
    return Pca(mean, _signed(axes[:, np.argsort(-values)[:dim]].T))


def _stacked(b: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(b[vec].to_numpy()).astype(np.float64)


def _means(pool: DataFrame, vec: str, d: int) -> tuple[int, np.ndarray]:
    def sums(batches):
        total = None
        for b in batches:
            if len(b):
                own = np.append(_stacked(b, vec).sum(0), len(b))
                total = own if total is None else total + own
        return total

    total = add_up(pool.select(vec), sums, d + 1)
    return int(total[-1]), total[:-1] / max(total[-1], 1)


def range_finder(pool: DataFrame, vec: str, dim: int, n: int, mean: np.ndarray, extra: int = 16, rounds: int = 40, tolerance: float = 1e-9, seed: int = 42) -> np.ndarray:
    """The first `dim` principal axes of wide rows, a row each, from sums over all rows of X'(XQ) for a d x (dim + extra) matrix Q.

    Q begins at random. A round takes the product on the executors, row by row without the matrix of products, and makes it orthonormal on
    the driver; rounds end when the wanted subspace turns by less than `tolerance` (its sine), or after `rounds` of them. The axes come from the small
    matrix Q'X'XQ. Memory: d x (dim + extra) numbers a task and on the driver.
    """
    d = len(mean)
    width = min(dim + extra, n, d)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    axes = None
    for _ in range(rounds):
        shared = pool.sparkSession.sparkContext.broadcast(q)

        def product(batches, shared=shared):
            total = None
            for b in batches:
                if len(b):
                    x = _stacked(b, vec) - mean
                    own = x.T @ (x @ shared.value)
                    total = own if total is None else total + own
            return None if total is None else total.ravel()

        z = add_up(pool.select(vec), product, d * width).reshape(d, width)
        shared.unpersist()
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        order = np.argsort(-values)[:dim]
        found = (q @ turn[:, order]).T
        own = found[values[order] > 1e-12 * values[order[0]]]  # directions without variance turn as they like
        turned = 1.0 if axes is None else np.linalg.norm(own.T - axes.T @ (axes @ own.T), 2)
        axes = found
        if turned < tolerance:
            break
        q = np.linalg.qr(z)[0]
    return axes


def apply_pca(df: DataFrame, vec: str, model: Pca | None, out: str) -> DataFrame:
    """df with the projected column; the column itself without a model."""
    ship(df.sparkSession)
    if model is None:
        return df.withColumn(out, F.col(vec).cast("array<double>"))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out)
    names = [c for c in df.columns if c != out]

    def run(batches):
        for b in batches:
            x = np.stack(b[vec].to_numpy()).astype(np.float64) if len(b) else np.empty((0, len(model.mean)))
            yield b[names].assign(**{out: list(model.apply(x))})

    return df.mapInPandas(run, f"{fields}, `{out}` array<double>")


def fit_codebook(points: DataFrame, vec: str, k: int, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """k-means centres by MLlib (Lloyd's algorithm), in a reproducible order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    centres = np.array(KMeans(k=k, maxIter=rounds, seed=seed).fit(rows).clusterCenters())
    return centres[np.lexsort(centres.T[::-1])]


def fit_mixture(points: DataFrame, vec: str, k: int, rounds: int = 100, floor: float = 1e-6, tolerance: float = 1e-4, starts: int = 2) -> K.Mixture:
    """Diagonal Gaussian mixture by EM. A round's k*(2d+1) sums are added on the executors; one copy comes to the driver.

    Each start takes k-means centres and variances of all rows; the likeliest end is kept.
    """
    from .statistics import vector_moments

    ship(points.sparkSession)
    points = points.select(vec)
    size = points.agg(F.sum(F.size(vec)) * 8).first()[0] or 0
    # rounds are many: no more tasks than there are cores, or blocks of 64 MB
    points = points.coalesce(max(points.sparkSession.sparkContext.defaultParallelism, -(-size // (64 << 20)))).persist()
    spread = np.array([r[0] for r in vector_moments(points, vec).orderBy("pos").select("variance").collect()])
    ends = [_expect(points, vec, fit_codebook(points, vec, k, seed=42 + i), spread + floor, rounds, floor, tolerance) for i in range(starts)]
    points.unpersist()
    return max(ends, key=lambda e: e[0])[1]


def _expect(points: DataFrame, vec: str, centres: np.ndarray, spread: np.ndarray, rounds: int, floor: float, tolerance: float) -> tuple[float, K.Mixture]:
    """(log-likelihood in the last round, mixture) of EM from centres."""
    k = len(centres)
    model = K.Mixture(np.full(k, 1 / k), centres, np.tile(spread, (k, 1)))
    likelihood, last = -np.inf, -np.inf
    for _ in range(rounds):
        def step(batches, model=model):
            total = None
            for b in batches:
                if len(b):
                    x = _stacked(b, vec)
                    joint = model.log_joint(x)
                    fit = np.logaddexp.reduce(joint, axis=1)
                    q = np.exp(joint - fit[:, None])
                    own = np.append(np.concatenate([q.sum(0)[:, None], q.T @ x, q.T @ (x * x)], axis=1), fit.sum())
                    total = own if total is None else total + own
            return total

        sums = add_up(points, step, k * (2 * centres.shape[1] + 1) + 1)
        t, likelihood = sums[:-1].reshape(k, -1), sums[-1]
        n, d = np.maximum(t[:, 0], 1e-12), (t.shape[1] - 1) // 2
        means = t[:, 1 : d + 1] / n[:, None]
        variances = np.maximum(t[:, d + 1 :] / n[:, None] - means**2, floor)
        moved = np.abs(means - model.means).max()
        model = K.Mixture(n / n.sum(), means, variances)
        if moved < tolerance or moved == last:
            break
        last = moved
    return likelihood, model


def fit_boxes(parts: DataFrame, metadata: DataFrame) -> dict[str, tuple[int, int, int, int]]:
    """A box for each group of landmarks: mean +- max(16, 1.8 deviations) of visible points in crop coordinates."""
    group = F.create_map(*[F.lit(x) for name, ids in K.PARTS.items() for i in ids for x in (i, name)])
    m = metadata.filter((F.col("bbox_w") > 1e-6) & (F.col("bbox_h") > 1e-6)).select("img_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    p = parts.filter("visible = 1").withColumn("part", group[F.col("part_id")]).filter("part is not null").join(m, "img_id")
    x, y = (F.col("x") - F.col("bbox_x")) / F.col("bbox_w") * K.SIDE, (F.col("y") - F.col("bbox_y")) / F.col("bbox_h") * K.SIDE
    rows = p.select("part", x.alias("px"), y.alias("py")).groupBy("part").agg(F.avg("px"), F.avg("py"), F.stddev_pop("px"), F.stddev_pop("py")).collect()
    boxes = dict(K.BOXES)
    for part, mx, my, sx, sy in rows:
        px, py = max(16.0, 1.8 * sx), max(16.0, 1.8 * sy)
        boxes[part] = K.clip_box((mx - px, my - py, mx + px, my + py))
    return boxes


@dataclass(frozen=True)
class Tier2:
    """All that a tier-2 encoder needs."""

    region: K.RegionModel
    codebook: np.ndarray
    idf: np.ndarray
    mixture: K.Mixture
    descriptor: Pca | None
    reduce: tuple[Pca, Pca, Pca]
    final: Pca
    stride: int
    word_sample: int

    def blocks(self, r: K.Raster) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        whole, parts = K.regions(r, self.region)
        words = K.colour_words(r, self.codebook, self.region.boxes, self.idf, self.word_sample)
        local = K.patches(r.gray / 255.0, stride=self.stride)
        return whole, words, K.fisher_vector(local, self.mixture), K.layout(r), parts

    def encode(self, r: K.Raster) -> tuple[np.ndarray, np.ndarray]:
        """The unit embedding and the five parts' descriptors."""
        whole, words, local, layout, parts = self.blocks(r)
        joined = np.concatenate([*(p.apply(x[None])[0] for p, x in zip(self.reduce, (whole, words, local), strict=True)), layout])
        return K.unit_norm(self.final.apply(joined[None])[0]), parts


def _rasters(b: pd.DataFrame):
    for i, h, w, data in zip(b["img_id"], b["height"], b["width"], b["rgb"], strict=True):
        yield i, K.Raster(np.frombuffer(data, np.uint8).reshape(h, w, 3))


def fit_tier2(
    images: DataFrame, boxes: dict, speed: Speed, dims: tuple[int, int, int] = (512, 256, 512), most: int = 0, words: int = 256, per_image: int = 400, final_dim: int = 512,
) -> Tier2:
    """Fit on all images, or on `most` of them by hash order. An image that can't be read fails the fit.

    Banks, colour words, patches, blocks and their reductions are computed on the executors, the reductions from all rows. The driver sees
    moments, centres, and one copy of each sum.
    """
    from .statistics import vector_moments

    ship(images.sparkSession)
    pool = (sample_rows(images, "img_id", most) if most else images).persist()
    names = ("colour", "lbp1", "lbp2", "lbp3", "moments")

    def bank(batches):
        for b in batches:
            rows = [(i, *(K.region_banks(r)[n] for n in names)) for i, r in _rasters(b)]
            yield pd.DataFrame(rows, columns=["img_id", *names])

    banks = pool.mapInPandas(bank, "img_id int, " + ", ".join(f"{n} array<double>" for n in names)).persist()

    def best(name: str, k: int) -> np.ndarray:
        rows = vector_moments(banks, name).orderBy(F.desc("variance"), "pos").limit(k).select("pos").collect()
        return np.sort(np.array([r[0] for r in rows]))

    limits = vector_moments(banks, "moments").orderBy("pos").select("low", "high").toPandas()
    region = K.RegionModel(best("colour", 48), (best("lbp1", 21), best("lbp2", 21), best("lbp3", 22)), limits["low"].to_numpy(), limits["high"].to_numpy(), boxes, speed.exact_colours, speed.colour_sample, speed.colour_rounds)

    def pixels(batches):
        for b in batches:
            for _, r in _rasters(b):
                yield pd.DataFrame({"v": list(K.spread_rows(r.lab[K.foreground(r)], per_image))})

    def local(batches):
        for b in batches:
            for _, r in _rasters(b):
                yield pd.DataFrame({"v": list(K.spread_rows(K.patches(r.gray / 255.0, stride=speed.patch_stride), per_image))})

    codebook = fit_codebook(pool.mapInPandas(pixels, "v array<double>"), "v", words)
    mixture = fit_mixture(pool.mapInPandas(local, "v array<double>"), "v", speed.mixture)

    def present(batches):
        for b in batches:
            for i, r in _rasters(b):
                hit = K.colour_words(r, codebook, boxes, np.ones(len(codebook)), speed.word_sample).reshape(len(K.PARTS), -1) > 0
                yield pd.DataFrame({"img_id": i, "word": np.flatnonzero(hit.any(axis=0)).astype(np.int32)})

    n = pool.count()
    seen = {r[0]: r[1] for r in pool.mapInPandas(present, "img_id int, word int").groupBy("word").agg(F.countDistinct("img_id")).collect()}
    idf = np.log((n + 1) / (np.array([seen.get(i, 0) for i in range(len(codebook))]) + 1))
    raw = Tier2(region, codebook, idf, mixture, None, (None, None, None), None, speed.patch_stride, speed.word_sample)  # type: ignore[arg-type]

    def blocks(batches):
        for b in batches:
            rows = [(i, *raw.blocks(r)[:4]) for i, r in _rasters(b)]
            yield pd.DataFrame(rows, columns=["img_id", "a", "b", "c", "d"])

    wide = pool.mapInPandas(blocks, "img_id int, a array<double>, b array<double>, c array<double>, d array<double>").persist()
    reduce = tuple(fit_pca(wide, c, dim, rotate=True) for c, dim in zip("abc", dims, strict=True))

    def join(batches):
        for b in batches:
            if len(b):
                parts = [p.apply(np.stack(b[c].to_numpy())) for p, c in zip(reduce, "abc", strict=True)]
                yield pd.DataFrame({"img_id": b["img_id"], "v": list(np.concatenate([*parts, np.stack(b["d"].to_numpy())], axis=1))})

    joined = wide.mapInPandas(join, "img_id int, v array<double>").persist()
    final = fit_pca(joined, "v", final_dim, rotate=True)
    for df in (joined, wide, banks, pool):
        df.unpersist()
    return Tier2(region, codebook, idf, mixture, None, reduce, final, speed.patch_stride, speed.word_sample)


def encode_tier2(images: DataFrame, model: Tier2) -> DataFrame:
    """(img_id, embedding, parts); images that can't be encoded give no row."""
    ship(images.sparkSession)
    shared = images.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            rows = []
            for i, h, w, data in zip(b["img_id"], b["height"], b["width"], b["rgb"], strict=True):
                try:
                    vec, parts = shared.value.encode(K.Raster(np.frombuffer(data, np.uint8).reshape(h, w, 3)))
                except (ValueError, TypeError, IndexError):
                    continue
                rows.append((i, vec.astype(np.float32), [p.astype(np.float32) for p in parts]))
            yield pd.DataFrame(rows, columns=["img_id", "embedding", "parts"])

    return images.select("img_id", "height", "width", "rgb").mapInPandas(run, "img_id int, embedding array<float>, parts array<array<float>>")


def tier2_table(spark, model: Tier2) -> DataFrame:
    """A model as a table of named arrays (name, shape, values): no code is stored and none runs on loading."""
    m = model.region
    arrays = {"colours": m.colours, **{f"patterns{i}": p for i, p in enumerate(m.patterns)}, "low": m.low, "high": m.high, "codebook": model.codebook, "idf": model.idf}
    arrays |= {f"box_{k}": np.array(v) for k, v in m.boxes.items()}
    arrays |= {"weights": model.mixture.weights, "means": model.mixture.means, "variances": model.mixture.variances}
    for name, p in (*((f"pca{i}", p) for i, p in enumerate(model.reduce)), ("final", model.final)):
        arrays |= {f"{name}_mean": p.mean, f"{name}_axes": p.axes}
    arrays["settings"] = np.array([m.exact_colours, m.colour_sample, m.colour_rounds, model.stride, model.word_sample])
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in arrays.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")


def tier2_of(table: DataFrame) -> Tier2:
    a = {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in table.toLocalIterator()}
    ids = lambda k: a[k].astype(np.int64)
    exact, sample, rounds, stride, words = a["settings"].astype(int).tolist()
    boxes = {k.removeprefix("box_"): tuple(v.astype(int).tolist()) for k, v in a.items() if k.startswith("box_")}
    region = K.RegionModel(ids("colours"), tuple(ids(f"patterns{i}") for i in range(3)), a["low"], a["high"], boxes, bool(exact), sample, rounds)
    pca = lambda k: Pca(a[f"{k}_mean"], a[f"{k}_axes"])
    return Tier2(region, a["codebook"], a["idf"], K.Mixture(a["weights"], a["means"], a["variances"]), None, tuple(pca(f"pca{i}") for i in range(3)), pca("final"), stride, words)


def save_tier2(spark, model: Tier2, path: str) -> None:
    tier2_table(spark, model).write.mode("overwrite").parquet(path)


def load_tier2(spark, path: str) -> Tier2:
    return tier2_of(spark.read.parquet(path))
