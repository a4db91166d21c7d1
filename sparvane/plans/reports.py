"""Reports of a build: counts of the set, what the attributes tell of the classes, sizes of the vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NOT_SEARCHED
from ..operators import statistics
from ..sources import tables

# Attributes that no class is told apart by, and how many are.
NOT_TELLING = ("cattr_centroid_y", "cattr_centroid_x", "cattr_val_mean")
TELLING = 8


def dataset_summary(meta: DataFrame) -> DataFrame:
    """One row: images, classes, training and test images, mean (2 digits), least and most images a class. meta has class_id, is_train."""
    per = meta.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_train") != 0).alias("train"))
    sums = per.agg(F.sum("n").alias("images"), F.count(F.lit(1)).alias("classes"), F.sum("train").alias("train"), F.bround(F.avg("n"), 2).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))
    whole = sums.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("images", "train")})
    return whole.select("images", "classes", "train", (F.col("images") - F.col("train")).alias("test"), "mean", "least", "most")


def information(tier1: DataFrame, meta: DataFrame) -> DataFrame:
    """(attribute, fisher_score, mutual_information, …, combined, rank) of tier 1's attributes by the images' classes."""
    names = [c for c in tier1.columns if c.startswith("cattr_")]
    scores = statistics.attribute_information(tier1.join(meta.select("img_id", "class_id"), "img_id"), names, "class_id")
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("combined", 12)), "attribute")))  # a row for each attribute


def similarity_attributes(columns: Sequence[str]) -> list[str]:
    """Attributes that a search compares."""
    return [c for c in columns if c.startswith("cattr_") and c not in NOT_SEARCHED]


def difference_attributes(info: DataFrame, most: int = TELLING) -> list[str]:
    """The attributes that tell most of the classes, best first, without those that tell of the picture alone."""
    rows = info.filter(~F.col("attribute").isin(*NOT_TELLING)).orderBy("rank").limit(most).select("attribute").collect()
    return [r[0] for r in rows]


def feature_report(meta: DataFrame, tier1: DataFrame, vectors: dict[str, DataFrame], vec: str = "vec", share: str = "cattr_color_green_ratio", place: str = "cattr_centroid_y") -> str:
    """A build as Markdown: counts, attributes for likeness and for difference with what they tell, sizes of the vectors, and two looks for bias
    (how the attribute `share` is distributed, and the classes whose mean of `place` is farthest from the middle). Only rows of a class, attribute or table reach the driver.
    """
    info = information(tier1, meta).persist()
    telling = difference_attributes(info)
    spark = meta.sparkSession
    likeness = spark.createDataFrame([(c,) for c in similarity_attributes(tier1.columns)] or [("none",)], "attribute string")
    difference = info.filter(F.col("attribute").isin(*telling)).orderBy("rank").select("attribute", *[F.bround(c, 4).alias(c) for c in ("fisher_score", "mutual_information", "combined")])
    sizes = [(n, (df.select(F.size(vec)).first() or [0])[0]) for n, df in vectors.items()]
    widths = spark.createDataFrame([("tier1", len([c for c in tier1.columns if c.startswith("cattr_")])), ("likeness", likeness.count()), ("difference", len(telling)), *sizes], "vector string, columns int")
    parts = [tables.markdown(dataset_summary(meta), "Set"), tables.markdown(likeness, "Attributes for likeness"), tables.markdown(difference, "Attributes for difference"), tables.markdown(widths, "Vectors")]
    if share in tier1.columns:
        spread = statistics.distribution(tier1, share, 0.01)
        parts.append(tables.markdown(spread.select(*[F.bround(c, 4).alias(c) for c in spread.columns]), f"Distribution of {share}"))
    if place in tier1.columns:
        by = statistics.class_stats(tier1.join(meta.select("img_id", "class_name"), "img_id"), ["class_name"], [place])
        far = by.orderBy(F.desc(F.abs(F.col(f"{place}_mean") - 0.5)), "class_name").limit(10)
        parts.append(tables.markdown(far.select("class_name", *[F.bround(c, 4).alias(c) for c in far.columns if c.endswith(("_mean", "_std"))], f"{place}_count"), f"Classes by {place}"))
    info.unpersist()
    return "\n".join(parts)
