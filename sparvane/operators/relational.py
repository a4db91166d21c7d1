"""Relational operators over annotation tables: joins, flags, predicates, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient in double; null over zero, where plain ANSI division would raise."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def normalized_offset(a: Column, b: Column, size: Column, missing: float = -1.0) -> Column:
    """|a - b| / size, `missing` where a landmark is absent or size is not positive."""
    return F.when(a.isNotNull() & b.isNotNull() & (size > 0), F.abs(a - b) / size).otherwise(F.lit(missing))


def largest_offset(points: Sequence[Column], origin: Column, size: Column, missing: float = -1.0) -> Column:
    """max over present points of (point - origin) / size, `missing` where none is present."""
    best = F.greatest(*points) if len(points) > 1 else points[0]
    return F.when(best.isNotNull() & (size > 0), (best - origin) / size).otherwise(F.lit(missing))


def _flags(flags: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()]


def _last(picks: dict[str, tuple[Column, Column]], position: str) -> list[Column]:
    return [F.max_by(F.when(c, v), F.when(c, F.col(position))).alias(n) for n, (c, v) in picks.items()]


def presence_flags(facts: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """One row per key with a boolean for each condition that any of its facts meets: one shuffle for all flags."""
    return facts.groupBy(key).agg(*_flags(flags))


def last_value_per_key(facts: DataFrame, key: str, picks: dict[str, tuple[Column, Column]], position: str) -> DataFrame:
    """One row per key; each pick is (condition, value), of which the last row by position wins."""
    return facts.groupBy(key).agg(*_last(picks, position))


def flags_and_last(facts: DataFrame, key: str, flags: dict[str, Column], picks: dict[str, tuple[Column, Column]], position: str) -> DataFrame:
    """What `presence_flags` and `last_value_per_key` give, in one aggregate."""
    return facts.groupBy(key).agg(*_flags(flags), *_last(picks, position))


def exclude(df: DataFrame, key: str, blocked: DataFrame) -> DataFrame:
    """Rows whose key is not in the one-column table `blocked`."""
    return df.join(blocked.select(F.col(blocked.columns[0]).alias(key)).distinct(), key, "left_anti")


def keep(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select(F.col(wanted.columns[0]).alias(key)).distinct(), key, "left_semi")


def reindex(ids: DataFrame, key: str, facts: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Every id once, with its facts or the fill values."""
    out = ids.select(key).distinct().join(facts, key, "left")
    return out.select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def majority(df: DataFrame, group: str, flag: Column, name: str = "majority") -> DataFrame:
    """Whether at least half of a group's known flags are true."""
    return df.filter(flag.isNotNull()).groupBy(group).agg((F.avg(flag.cast("double")) >= 0.5).alias(name))


def smallest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).asc_nulls_last(), F.col(key)).limit(n)


def hash_rank(key: str, seed: int) -> Column:
    """A uniform order of keys that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least hash_rank.

    Of a larger table only rows below a threshold, about twice as many as are wanted, are sorted, so
    the task that ends the sort reads about that many however many partitions there are.
    """
    rank, share = hash_rank(key, seed), (2 * n + 100) / max(1, df.count())
    if share < 1:
        df = df.filter(F.conv(F.substring(rank, 1, 12), 16, 10).cast("long") < int(share * (1 << 48)))
    return df.orderBy(rank, key).limit(n)


def stratified_sample(df: DataFrame, group: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """About cap rows in proportion to group sizes, one per group at least, cut to cap in the end.

    At most cap rows of a group can be taken, and the ranking keeps no more of it in memory.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    if total <= cap:
        return df
    ranked = df.withColumn("_h", hash_rank(key, seed))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).filter(F.col("_r") <= cap)
    quota = F.greatest(F.lit(1), F.bround(F.lit(cap / total) * F.col("_n"), 0).cast("long"))
    taken = ranked.join(sizes, group).filter(F.col("_r") <= quota)
    return taken.orderBy("_h", key).limit(cap).drop("_h", "_r", "_n")


def two_level(df: DataFrame, group: str) -> DataFrame:
    """Number of groups and mean, least and largest group size."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def dense_ids(df: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based positions along `order`, without gaps, from counts per range partition.

    The number of partitions, not of rows, is what one task sees at a time.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    spread = spread.withColumn("_p", F.shiftright("_m", 33)).persist()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    local = F.col("_m") - F.shiftleft(F.col("_p"), 33)
    return spread.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(name, F.col("_s") + local).drop("_m", "_p", "_q", "_s")
