"""Quality rules: decision lists learnt by sequential covering, as ordered Spark conditions.

A rule is a conjunction of thresholds on text statistics that marks a text as bad. Rules
are grown one by one on two thirds of the labelled rows that no rule covers yet, each condition
being the one of most information gain; pruned from their end on the other third; and kept
while what they mark there is bad often enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textstats import COUNTS, RATIOS, sample_by_hash, text_stats, training_fold

MIN_WORDS, MAX_REPEATS = 50, 50


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.threshold) if self.above else F.col(self.name) < F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.threshold if self.above else x[self.name] < self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of most FOIL gain among these rows. Cuts lie midway between neighbouring values."""
    p, n = bad.sum(), (~bad).sum()
    base = np.log2(max(p, 1e-9) / max(p + n, 1e-9))
    best: tuple[float, Condition | None] = (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        if not len(cut):
            continue
        below = np.concatenate(([0], np.cumsum(b)))[cut]
        for above, pos, size in ((False, below, cut), (True, p - below, len(v) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - base), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] - 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, support: int = 5, seed: int = 7, grow: np.ndarray | None = None) -> list[Rule]:
    """Ordered rules for bad rows. No bad rows, or no good ones, give none or one that stands for all.

    `grow` flags the rows on which rules grow (the others prune them), two thirds by chance where it is None. Nothing else depends on the order of rows.
    """
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    grow = rng.random(len(bad)) < 2 / 3 if grow is None else grow
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        own = left & grow
        rule: list[Condition] = []
        while len(rule) < most_conditions and bad[own].any() and (~bad[own]).any():
            _, c = _best({k: v[own] for k, v in x.items()}, bad[own])
            if c is None:
                break
            rule.append(c)
            own = own & c.holds(x)
        held = left & ~grow
        worth = []
        for k in range(1, len(rule) + 1):
            hit = covers(tuple(rule[:k]), x, len(bad)) & held
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            worth.append(((p - n) / max(1, p + n), p, n))
        if not worth:
            break
        k = max(range(len(worth)), key=lambda i: (round(worth[i][0], 6), worth[i][1]))
        _, p, n = worth[k]
        if p < support or p / (p + n) < precision:
            break
        rules.append(tuple(rule[: k + 1]))
        left &= ~covers(rules[-1], x, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """False where a rule marks the text, tested in order; else true."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> list[Rule]:
    """Rules from labelled rows of the training fold: those of at most `most_rows` ids (least by hash), and of their rows about as many.

    Rows of one doc_id that differ are rows of their own, equal ones count once. Which rows grow rules and which prune them, and which stay where there are too
    many, follows from a hash of id and statistics, so neither the order of rows nor their partitions matter.
    """
    own = labels.filter("quality is not null and doc_id is not null").filter(training_fold()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
    chosen = sample_by_hash(own.withColumnRenamed("_id", "doc_id"), most_rows, "rules")
    rows = materialize(stats.join(chosen, "doc_id").select(*RATIOS, "_quality", F.xxhash64(F.lit("rules"), "doc_id", *COUNTS, *RATIOS).alias("_key")).dropDuplicates(["_key"]), "rules-sample")
    n = rows.count()
    if n > most_rows:
        rows = rows.filter(F.pmod("_key", F.lit(1 << 40)) < int(most_rows / n * (1 << 40)))
    held = rows.orderBy("_key").toPandas()
    return learn({c: held[c].to_numpy() for c in RATIOS}, held["_quality"].to_numpy() == 0, grow=(held["_key"].to_numpy() >> 16) % 3 != 0, **options)


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """text_stats' columns, base_failed and kept, one row for each row of docs.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word
    windows; so null and empty texts fail. kept is false for those and for what a learnt
    rule marks. Without labels there are no rules, and the base alone decides.
    """
    stats = materialize(text_stats(docs), "rules-stats")
    rules = fit(stats, labels, **options)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATS * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
