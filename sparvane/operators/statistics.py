"""Statistics of columns and vectors: moments, quantiles, information scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of each value per class."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    return df.groupBy(*keys).agg(*aggs)


#: rank error of a sketch, as a share of the rows it has seen, is at most one in so many
ACCURACY = 10_000
#: distinct values within the brackets that come to the driver
WITHIN = 200_000


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float]]:
    """Exact linear quantiles of several columns, nulls left out, NaN above all numbers; no list for a column without values.

    Selection by brackets: one pass sketches all columns (mergeable, bounded memory), and values around each wanted rank bracket it.
    A second pass counts what lies below each bracket and how often each distinct value within it occurs, about four in ACCURACY rows.
    Were these more than WITHIN values, the brackets would be sketched again, from what they hold alone. A rank outside its bracket opens that to the side where it lies.
    """
    wanted = {c: F.col(c).cast("double") for c in columns}
    stats = df.select(*[x.alias(f"_{i}") for i, x in enumerate(wanted.values())])
    share = sorted(set(shares))
    around = [min(1.0, max(0.0, q + e)) for q in share for e in (-2 / ACCURACY, 2 / ACCURACY)]
    first = stats.agg(*[f for i in range(len(columns)) for f in (F.count(f"_{i}").alias(f"n{i}"), F.min(f"_{i}").alias(f"low{i}"), F.max(f"_{i}").alias(f"high{i}"), F.percentile_approx(f"_{i}", around, ACCURACY).alias(f"s{i}"))]).first()
    n = {i: first[f"n{i}"] for i in range(len(columns))}
    # (column, rank) -> bracket; a rank's neighbour has one of its own
    brackets: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(columns)):
        for j, q in enumerate(share):
            for place in {f(q * (n[i] - 1)) for f in (math.floor, math.ceil)} if n[i] else ():
                whole = n[i] <= ACCURACY
                brackets[i, place] = (first[f"low{i}"], first[f"high{i}"]) if whole else tuple(first[f"s{i}"][2 * j : 2 * j + 2])
    ends = {i: (first[f"low{i}"], first[f"high{i}"]) for i in range(len(columns))}
    found: dict[tuple[int, int], float] = {}
    while brackets:
        spans = sorted({(i, *b) for (i, _), b in brackets.items()}, key=repr)
        inside = [(F.col(f"_{i}") >= F.lit(low)) & (F.col(f"_{i}") <= F.lit(high)) for i, low, high in spans]
        counts = stats.agg(*[F.count_if(F.col(f"_{i}") < F.lit(low)) for i, low, _ in spans], *[F.count_if(x) for x in inside]).first()
        below, held = counts[: len(spans)], counts[len(spans) :]
        wide = [k for k, (_, low, high) in enumerate(spans) if low != high]  # the others hold one value
        values, most = [], max(WITHIN, 8 * len(spans))  # no bracket need be narrower than a few values
        if wide:
            which = F.explode(F.filter(F.array(*[F.when(inside[k], F.struct(F.lit(k).alias("k"), F.col(f"_{spans[k][0]}").alias("x"))) for k in wide]), lambda s: s.isNotNull()))
            within = stats.filter(reduce(lambda a, b: a | b, [inside[k] for k in wide]))
            values = within.select(which.alias("s")).select("s.*").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
        left: dict[tuple[int, int], tuple[float, float]] = {}
        if len(values) <= most:
            runs: dict[int, list[tuple[float, int]]] = {}
            for k, x, m in sorted(values, key=lambda r: (r.k, math.isnan(r.x), r.x)):
                runs.setdefault(k, []).append((x, m))
        else:
            sketches = stats.agg(*[F.percentile_approx(F.when(x, F.col(f"_{spans[k][0]}")), [min(1.0, max(0.0, (p - below[k] + more) / max(1, held[k]) + e)) for (i, p), b in brackets.items() if (i, *b) == spans[k] for more, e in ((0, -2 / ACCURACY), (1, 2 / ACCURACY))], ACCURACY) for k, x in enumerate(inside) if k in wide]).first()
            narrowed = {k: iter(x or ()) for k, x in zip(wide, sketches, strict=True)}
        for (i, place), b in brackets.items():
            k = spans.index((i, *b))
            if place < below[k]:
                left[i, place] = (ends[i][0], b[1])
            elif place >= below[k] + held[k]:
                left[i, place] = (b[0], ends[i][1])
            elif len(values) > most and k in wide:
                left[i, place] = (next(narrowed[k]), next(narrowed[k]))
            else:
                at = below[k]
                for x, m in runs[k] if k in wide else [(b[0], held[k])]:
                    at += m
                    if place < at:
                        found[i, place] = x
                        break
        brackets = left

    def linear(i: int, q: float) -> float:
        place = q * (n[i] - 1)
        a, b = found[i, math.floor(place)], found[i, math.ceil(place)]
        return a if a == b else a + (b - a) * (place - math.floor(place))

    return {name: [linear(i, q) for q in shares] if n[i] else [] for i, name in enumerate(columns)}


def distribution(df: DataFrame, value: str, threshold: float, at: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """One row: mean, sample deviation, exact linear quantiles and the share below a threshold."""
    found = quantiles(df, [value], at)[value] or [None] * len(at)
    named = [F.lit(x).cast("double").alias(f"q{round(100 * p)}") for p, x in zip(at, found, strict=True)]
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) < threshold).cast("double")).alias("below")).select("mean", "std", *named, "below")


def zscore_columns(df: DataFrame, values: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation per column, of df itself or of a reference pool; deviations under 1e-8 count as 1."""
    pool = (reference if reference is not None else df).agg(
        *[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values]
    )
    out = df.crossJoin(F.broadcast(pool))  # one row
    scale = lambda v: F.when(F.col(f"_s_{v}") < 1e-8, 1.0).otherwise(F.col(f"_s_{v}"))
    return out.withColumns({v: (F.col(v) - F.col(f"_m_{v}")) / scale(v) for v in values}).drop(*pool.columns)


def vector_moments(df: DataFrame, vec: str) -> DataFrame:
    """(pos, mean, std, variance, low, high) of a vector column's places, population form, std under 1e-8 as 1."""
    each = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    m = each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("variance"), F.min("x").alias("low"), F.max("x").alias("high"))
    return m.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def zscore_vectors(df: DataFrame, vec: str, reference: DataFrame | None = None) -> DataFrame:
    """The vector column z-scored place by place against df or a reference pool."""
    moments = vector_moments(reference if reference is not None else df, vec)
    row = moments.agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("_m"))  # one row, as wide as a vector
    z = F.zip_with(F.col(vec).cast("array<double>"), F.col("_m"), lambda x, m: (x - m["mean"]) / m["std"])
    return df.crossJoin(F.broadcast(row)).withColumn(vec, z).drop("_m")


def entropy_bits(counts: Column) -> Column:
    """Shannon entropy of an array of counts; 0 for an empty one."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, (x / total) * F.log2(x / total + F.lit(1e-12))).otherwise(0.0))


def _finite(value: str) -> Column:
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def codes(df: DataFrame, values: dict[str, str], bins: int = 8) -> DataFrame:
    """df with a column of codes for each of `values` (column: code's name): the number of inner quantile edges at or
    below the value; with two edges or fewer, whether it exceeds the median. Edges are the distinct linear quantiles
    at 0, 1/bins, ..., 1.

    Null, NaN and infinite values take no part in the edges and get code 0.
    """
    found = quantiles(df.select(*[_finite(v).alias(v) for v in values]), list(values), [*(i / bins for i in range(bins + 1)), 0.5])
    # each value is made finite once and then compared with its edges in turn: sums of tests that made it again grew past what the JVM compiles
    finite = {v: f"_finite_{i}" for i, v in enumerate(values)}
    out = {}
    for v, name in values.items():
        edges, x = sorted(set(found[v][:-1])), F.col(finite[v])
        code = F.when(x.isNull(), F.lit(0))
        if len(edges) <= 1:
            code = F.lit(0)
        elif len(edges) == 2:
            code = code.otherwise((x > F.lit(found[v][-1])).cast("int"))
        else:
            for i, e in enumerate(edges[1:-1]):
                code = code.when(x < F.lit(e), F.lit(i))
            code = code.otherwise(F.lit(len(edges) - 2))
        out[name] = code
    return df.withColumns({name: _finite(v) for v, name in finite.items()}).withColumns(out).drop(*finite.values())


def discretize(df: DataFrame, value: str, out: str, bins: int = 8) -> DataFrame:
    """One column's codes."""
    return codes(df, {value: out}, bins)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(pairs: DataFrame, group: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    """Mutual information in bits of two discrete columns, for each group."""
    joint = pairs.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*group))
    joint = joint.withColumns({
        "p": F.col("n") / total,
        "px": F.sum("n").over(Window.partitionBy(*group, a)) / total,
        "py": F.sum("n").over(Window.partitionBy(*group, b)) / total,
    })
    term = F.col("p") * F.log2(F.col("p") / (F.col("px") * F.col("py") + F.lit(1e-12)))
    mi = F.greatest(F.lit(0.0), F.sum(term))
    return joint.groupBy(*group).agg(mi.alias("mutual_information")) if group else joint.agg(mi.alias("mutual_information"))


def fisher_score(long: DataFrame, group: Sequence[str], label: str, value: str) -> DataFrame:
    """Between-class over within-class scatter for each group; 0 with one class or next to no scatter within."""
    return _fisher(long.groupBy(*group, label).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")), group)


def _fisher(per: DataFrame, group: Sequence[str]) -> DataFrame:
    """Fisher scores from each group's and class's rows (n), mean (m) and variance (v)."""
    total = Window.partitionBy(*group)
    overall = F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total)
    per = per.withColumn("between", F.col("n") * (F.col("m") - overall) * (F.col("m") - overall)).withColumn("within", F.col("n") * F.col("v"))
    score = F.when((F.count(F.lit(1)) < 2) | (F.sum("within") <= 1e-12), F.lit(0.0)).otherwise(F.sum("between") / F.sum("within"))
    return per.groupBy(*group).agg(score.alias("fisher_score"))


def min_max(value: str, window, constant: float) -> Column:
    """(x - min) / (max - min) over a window, `constant` where all are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high - low < 1e-12, F.lit(constant)).otherwise((F.col(value) - low) / (high - low))


def attribute_information(df: DataFrame, attributes: Sequence[str], label: str, bins: int = 8, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """Fisher score, mutual information, both min-max scaled over the attributes, and their weighted sum."""
    # moments of all attributes by class in one pass, without a row for each attribute
    wide = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(a).cast("double")).alias(f"{name}{i}") for i, a in enumerate(attributes) for name, f in (("m", F.avg), ("v", F.var_pop))])
    per = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, a in enumerate(attributes)])))
    coded = codes(df, {a: f"_c_{a}" for a in attributes}, bins)
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"_c_{a}").alias("code")) for i, a in enumerate(attributes)]))
    pairs = coded.select(F.col(label).alias("label"), both.alias("s")).select("label", "s.*")
    shared = mutual_information(pairs, ["at"], "code", "label").withColumn("attribute", F.get(F.array(*map(F.lit, attributes)), F.col("at"))).drop("at")
    scores = _fisher(per, ["attribute"]).join(shared, "attribute")
    every = Window.partitionBy()  # a row for each attribute
    scores = scores.withColumn("fisher_score_norm", min_max("fisher_score", every, 0.0)).withColumn("mutual_information_norm", min_max("mutual_information", every, 0.0))
    return scores.withColumn("combined", weights[0] * F.col("fisher_score_norm") + weights[1] * F.col("mutual_information_norm"))


def binary_pivot(facts: DataFrame, key: str, column: str, values: Sequence, flag: str, prefix: str = "attr_") -> DataFrame:
    """A row per key, a 0/1 column per listed value: the largest flag among its facts, 0 without any."""
    wide = facts.groupBy(key).pivot(column, list(values)).agg(F.max(flag))
    return wide.select(key, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("int").alias(f"{prefix}{v}") for v in values])


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pearson correlation of each left with each right column, in one pass: (a, b, r), 0 where a side is constant."""
    spread = F.stddev_pop
    r = lambda a, b: F.when((spread(a) > 1e-12) & (spread(b) > 1e-12), F.try_divide(F.covar_pop(a, b), spread(a) * spread(b))).otherwise(F.lit(0.0))
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a in left for b in right]
    return df.agg(F.array(*aggs).alias("c")).select(F.inline("c"))


def width_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins of [low, high], the last one closed; values outside are left out."""
    at = F.floor((F.col(value) - low) / ((high - low) / bins))
    inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
    return inside.select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def inverse_document_frequency(words: DataFrame, doc: str, word: str) -> DataFrame:
    """(word, df, idf) with idf = ln((n + 1) / (df + 1)), n the number of documents."""
    n = words.agg(F.countDistinct(doc).alias("_n"))  # one row
    return words.groupBy(word).agg(F.countDistinct(doc).alias("df")).crossJoin(F.broadcast(n)).withColumn("idf", F.log((F.col("_n") + 1) / (F.col("df") + 1))).drop("_n")
