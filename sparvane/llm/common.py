"""Shared plumbing: table access, the package on the workers, column names out of the way, prefix sums."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ship as package
from ..shared import discard, materialize, scratch, shared_path

__all__ = ["copies_of", "discard", "guarded", "materialize", "prefix_sums", "read", "scratch", "shared_path", "ship"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, and bound Arrow batches by bytes, so that a batch of long texts stays small."""
    package.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def guarded(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all columns but `own` under neutral names, so that none clashes with an operator's, and what gives a result df's names."""
    inner = [c if c in own else f"held{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*df.columns)


def prefix_sums(
    df: DataFrame, group: list[str], order: list[Column], value: str, rank: str, n_rows: str, out: str, rows: int = 256
) -> DataFrame:
    """Exclusive prefix sums of `value` within each `group`, in `order`, for groups of any size.

    `rank` is a column in [0, 1) that never decreases along `order` (a uniform hash
    key, say); `n_rows` holds the group's row count. A group of n rows is cut by rank
    into ranges of max(rows, sqrt(n)) rows, so neither a range nor the list of a
    group's ranges outgrows max(rows, sqrt(n)) rows by much: both levels fit in a task even
    where one group holds a third of the table.
    """
    parts = F.ceil(F.col(n_rows) / F.greatest(F.lit(rows), F.ceil(F.sqrt(F.col(n_rows)))))
    df = df.withColumn("_part", F.floor(F.col(rank) * F.greatest(parts, F.lit(1))))
    keys = [*group, "_part"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_base")
    df = df.join(sums, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), "left")
    return df.withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in", *[f"_r_{k}" for k in keys])


def copies_of(df: DataFrame, copies: str, number: str, most: int = 1 << 16) -> DataFrame:
    """df with each row `copies` times (a long column, from 1) and their `number` from 0: by ranges first, so that no array holds more than `most` of them."""
    ranges = df.withColumn("_from", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {most}")), lambda i: i * most)))
    return ranges.withColumn(number, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + most, F.col(copies)) - 1))).drop("_from")
