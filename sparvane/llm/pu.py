"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are labelled documents of the training fold, the unlabelled set all documents
without labels; negatives are never used. Scores are logistic over binned statistics. With the
logistic loss l the positives' part, prior * E_p[l(f)], and a share of the negatives' part,
E_u[l(-f)] - prior * E_p[l(-f)], are convex together, so Newton steps reach their least from a
few sums over all rows. Where the whole negatives' part would fall below zero, which is overfitting,
the least of the risk that counts it as zero lies at a smaller share, found by halving. The class prior of the
unlabelled set is the least ratio, over the score's upper tails, of its share there to the
positives' share (best-bin estimation), from scores of rows kept out of that fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship
from .textstats import RATIOS, text_stats, training_fold

_CELLS = 1 << 20
_TAILS = 2000
_ADDERS = 16
POSITIVE, UNLABELLED = 1, 0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def cells(x: np.ndarray) -> np.ndarray:
    """Numbers on a fixed grid that rise with the value: sign, exponent and first ten bits of a float, so a cell is a thousandth wide."""
    bits = np.ascontiguousarray(x, np.float32).view(np.int32)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) >> 13


@dataclass
class Model:
    """Logistic scores over statistics' cells, cut into bins that begin at `edges`; weights hold a row for each bin, then a bias."""

    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def bins(self, c: np.ndarray) -> np.ndarray:
        """Numbers of the bins, one column for each statistic."""
        base = np.cumsum([0, *(len(e) + 1 for e in self.edges[:-1])])
        return np.stack([np.searchsorted(e, c[:, i], side="right") + base[i] for i, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        return self.weights[b].sum(axis=1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(cells(x)))) if len(x) else np.empty(0)


Part = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Arrays:
    """Rows in memory: kind (POSITIVE or UNLABELLED), half (0 or 1) and cells."""

    def __init__(self, kind: np.ndarray, half: np.ndarray, grid: np.ndarray):
        self.own = kind, half, grid

    def sum(self, part: Part) -> np.ndarray:
        return part(*self.own)

    def tally(self, part: Part) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in np.unique(part(*self.own), return_counts=True)), strict=True))


class Rows:
    """The same rows of a table. Sums meet in a fixed number of tasks before the driver adds those up."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grid = b.column("grid").flatten().to_numpy().reshape(len(b), -1)
        return b.column("kind").to_numpy(), b.column("half").to_numpy(), grid

    def sum(self, part: Part) -> np.ndarray:
        def partial(batches):
            total = None
            for b in batches:
                if len(b):
                    own = part(*Rows._batch(b))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["s"])

        def add(batches):
            total = None
            for b in batches:
                for s in b.column("s"):
                    own = np.frombuffer(s.as_py())
                    total = own.copy() if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        sums = self.df.mapInArrow(partial, "s binary").repartition(_ADDERS).mapInArrow(add, "s binary").collect()
        return np.sum([np.frombuffer(bytes(r[0])) for r in sums], axis=0)

    def tally(self, part: Part) -> dict[int, int]:
        def count(batches):
            total: dict[int, int] = {}
            for b in batches:
                if len(b):
                    for k, n in zip(*(x.tolist() for x in np.unique(part(*Rows._batch(b)), return_counts=True)), strict=True):
                        total[k] = total.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["k", "n"])

        return {r[0]: r[1] for r in self.df.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}


def _edges(found: dict[int, int], width: int, bins: int) -> list[np.ndarray]:
    """Where bins begin: at even shares, finer in both tails, where odd texts lie."""
    tails = np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08])
    shares = np.unique(np.concatenate((np.arange(1, bins) / bins, tails, 1 - tails)))
    keys = np.array(sorted(found), np.int64)
    n = np.array([found[k] for k in keys.tolist()], np.float64)
    out = []
    for i in range(width):
        own = keys // _CELLS == i
        cell, cum = keys[own] % _CELLS - _CELLS // 2, np.cumsum(n[own])
        at = np.searchsorted(cum, shares * cum[-1]) + 1
        out.append(cell[np.unique(at[at < len(cell)])])
    return out


def _hessian(b: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Sum of weight * x x' over rows x that are one in the bins b and the bias."""
    b = np.concatenate((b, np.full((len(b), 1), size - 1)), axis=1)
    out = np.zeros(size * size)
    for i in range(b.shape[1]):
        for j in range(b.shape[1]):
            out += np.bincount(b[:, i] * size + b[:, j], weight, size * size)
    return out


def _newton(model: Model, pool, pieces: Callable, decay: float, rounds: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights of least convex risk, and another value there. pieces(fp, fu, ...) gives both values summed over rows, and both sides' first and second derivatives."""
    size = len(model.weights)
    penalty = np.full(size, decay)
    penalty[-1] = 0

    def sums(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        at = Model(model.edges, w, model.prior)

        def part(kind, half, grid):
            b = at.bins(grid)
            p, u = kind == POSITIVE, kind == UNLABELLED
            f = at.margin(b)
            values, (gp, hp), (gu, hu) = pieces(f[p], f[u], half[p], half[u])
            g, h = np.zeros(len(f)), np.zeros(len(f))
            g[p], g[u], h[p], h[u] = gp, gu, hp, hu
            grad = np.bincount(b.ravel(), np.repeat(g, b.shape[1]), size)
            grad[-1] += g.sum()
            return np.concatenate((values, grad, _hessian(b, h, size)))

        s = pool.sum(part)
        return s[0] + 0.5 * (penalty * w * w).sum(), s[1], s[2 : 2 + size] + penalty * w, s[2 + size :].reshape(size, size) + np.diag(penalty + 1e-9)

    last = w = np.zeros(size) if start is None else start
    best, other, step = np.inf, 0.0, np.zeros(size)
    for _ in range(rounds):
        risk, value, g, h = sums(w)
        if risk > best + 1e-9:  # too far: half the way back
            step = step / 2
        else:
            last, best, other = w, risk, value
            step = -np.linalg.solve(h, g)
            step *= min(1.0, 8 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
        w = last + step
    return last, other


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Least upper bound, over upper tails, of the positives' share of the unlabelled scores; both are counts by rising score."""
    tail = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    slack = lambda n: np.sqrt(np.log(4 / sure) / (2 * n.sum()))
    qp, qu = tail(positive), tail(unlabelled)
    enough = qp > slack(positive) * 3
    if not enough.any():
        return 0.5
    bound = (qu + slack(unlabelled) + slack(positive))[enough] / qp[enough]
    at = int(bound.argmin())
    return float(np.clip(qu[enough][at] / qp[enough][at], 0.02, 0.98))


def fit(pool, width: int, bins: int = 16, decay: float = 3e-4, rounds: int = 8, halvings: int = 5) -> Model:
    """The model of least non-negative risk over all rows of a pool. Without rows of either kind every score is a half."""
    counts = pool.sum(lambda kind, half, grid: np.array([((kind == k) & (half == h)).sum() for k in (POSITIVE, UNLABELLED) for h in (0, 1)], np.float64))
    if np.ndim(counts) == 0 or not counts[:2].sum() or not counts[2:].sum():
        return Model([np.empty(0, np.int64)] * width, np.zeros(width + 1), 0.5)
    edges = _edges(pool.tally(lambda kind, half, grid: (grid.astype(np.int64) + _CELLS // 2 + np.arange(grid.shape[1]) * _CELLS).ravel()), width, bins)
    model = Model(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1), 0.5)
    n_p, n_u = counts[:2], counts[2:]

    def plain(fp, fu, hp, hu):
        # logistic loss of positives against the unlabelled, on the first half
        a, b = (hp == 0) / n_p[0] / 2, (hu == 0) / n_u[0] / 2
        values = [(a * _softplus(-fp)).sum() + (b * _softplus(fu)).sum(), 0.0]
        return values, (-a * _sigmoid(-fp), a * _sigmoid(fp) * _sigmoid(-fp)), (b * _sigmoid(fu), b * _sigmoid(fu) * _sigmoid(-fu))

    prior = 0.5
    if counts.all():
        first = Model(edges, _newton(model, pool, plain, 1e-3, rounds)[0], 0.5)

        def tails(kind, half, grid):
            at = np.minimum((_sigmoid(first.margin(first.bins(grid))) * _TAILS).astype(np.int64), _TAILS - 1)
            return np.concatenate([np.bincount(at[(half == 1) & (kind == k)], minlength=_TAILS) for k in (POSITIVE, UNLABELLED)])

        both = pool.sum(tails)
        prior = estimate_prior(both[:_TAILS], both[_TAILS:])

    def risk(share: float) -> Callable:
        # positives' part + share * negatives' part, the former prior * E_p[l(f)], the latter E_u[l(-f)] - prior * E_p[l(-f)]
        a, b = prior / n_p.sum(), 1 / n_u.sum()

        def pieces(fp, fu, hp, hu):
            sp, su = _softplus(fp).sum(), _softplus(fu).sum()
            values = [a * ((1 - share) * sp - fp.sum()) + share * b * su, b * su - a * sp]
            curve = lambda f: _sigmoid(f) * _sigmoid(-f)
            return values, (a * ((1 - share) * _sigmoid(fp) - 1), a * (1 - share) * curve(fp)), (share * b * _sigmoid(fu), share * b * curve(fu))

        return pieces

    weights, negatives = _newton(model, pool, risk(1.0), decay, rounds)
    low, high = 0.0, 1.0
    for _ in range(halvings if negatives < 0 else 0):
        share = (low + high) / 2
        weights, negatives = _newton(model, pool, risk(share), decay, rounds // 2, weights)
        low, high = (low, share) if negatives < 0 else (share, high)
    return Model(edges, weights, prior)


def train(stats: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on all positives of the training fold and all rows without any label; neither is sampled."""
    ship(stats.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    trusted = F.max(((F.col("quality") == 1) & training_fold()).cast("int"))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(trusted.alias("_good"))
    kind = F.when(F.col("_id").isNull(), F.lit(UNLABELLED)).when(F.col("_good") == 1, F.lit(POSITIVE))
    rows = stats.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("kind", kind).filter("kind is not null")
    half = F.crc32(F.concat_ws(":", F.lit("half"), F.col("doc_id").cast("string")).cast("binary")) % 2

    def grid(batches):
        for b in batches:
            x = cells(np.stack([b.column(c).to_numpy() for c in RATIOS], axis=1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int32)), len(RATIOS)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("half"), flat], ["kind", "half", "grid"])

    pool = materialize(rows.select("kind", half.cast("int").alias("half"), *RATIOS).mapInArrow(grid, "kind int, half int, grid array<int>"), "pu-rows")
    model = fit(Rows(pool), len(RATIOS), **options)
    discard(pool)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of docs.

    Null and empty texts have statistics of zero and a score like any other. Labels of
    null doc_ids are not used, and such documents count as unlabelled. Without positives or
    unlabelled rows every score is 0.5.
    """
    ship(docs.sparkSession)
    stats = materialize(text_stats(docs), "pu-stats")
    model = train(stats, labels, **options)

    def score(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in RATIOS], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = stats.select("doc_id", *RATIOS).mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
