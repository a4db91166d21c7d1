"""Space-separated annotation files without headers, as typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Files and their columns.
SCHEMAS = {
    "images": ("images.txt", "img_id int, filepath string"),
    "labels": ("image_class_labels.txt", "img_id int, class_id int"),
    "classes": ("classes.txt", "class_id int, class_name string"),
    "boxes": ("bounding_boxes.txt", "img_id int, x double, y double, width double, height double"),
    "split": ("train_test_split.txt", "img_id int, is_train int"),
    "parts": ("parts/part_locs.txt", "img_id int, part_id int, x double, y double, visible int"),
    "attribute_labels": ("attributes/image_attribute_labels.txt", "img_id int, attr_id int, is_present int, certainty_id int, time double"),
    "attributes": ("attributes.txt", "attr_id int, attr_name string"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by the file system that Spark would read it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists; FileNotFoundError names all of them if none does."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def scan(spark: SparkSession, path: str, schema: str, position: str | None = None) -> DataFrame:
    """A file's rows; `position` names a column that orders them as they stand in the source: by file, then by block, then within the block.

    It is taken where the rows are read, so neither the splits nor what is done to the rows later change the order.
    """
    rows = spark.read.schema(schema).option("sep", " ").option("mode", "PERMISSIVE").csv(path)
    if not position:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(position))


def state(spark: SparkSession, root: str) -> tuple:
    """Path, length and time of change of each annotation file that is there: what a build's first step depends on."""
    root, jvm, out = root.rstrip("/"), spark.sparkContext._jvm, []
    for path in [*(f"{root}/{file}" for file, _ in SCHEMAS.values()), f"{root}/attributes/attributes.txt", f"{root}/../attributes.txt"]:
        if exists(spark, path):
            p = jvm.org.apache.hadoop.fs.Path(path)
            status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
            out.append((path, status.getLen(), status.getModificationTime()))
    return tuple(out)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables, with the joined `master`. The attribute names may lie in three places; response times are not read. `parts` has its rows' place in the source as source_at."""
    root = root.rstrip("/")
    out = {}
    for name, (file, schema) in SCHEMAS.items():
        path = f"{root}/{file}"
        if name == "attributes":
            path = first_existing(spark, [path, f"{root}/attributes/attributes.txt", f"{root}/../attributes.txt"])
        elif not exists(spark, path):
            raise FileNotFoundError(path)
        out[name] = scan(spark, path, schema, "source_at" if name == "parts" else None)
    out["attribute_labels"] = out["attribute_labels"].select("img_id", "attr_id", "is_present", "certainty_id")
    out["master"] = master(out)
    return out


def master(t: dict[str, DataFrame]) -> DataFrame:
    """img_id, filepath, class_id, class_name, x, y, width, height, is_train."""
    out = t["images"].join(t["labels"], "img_id").join(t["classes"], "class_id").join(t["boxes"], "img_id").join(t["split"], "img_id")
    return out.select("img_id", "filepath", "class_id", "class_name", "x", "y", "width", "height", "is_train")


def fit_pool(master: DataFrame, kept: DataFrame) -> DataFrame:
    """All images of the classes that `kept` holds."""
    return master.join(kept.select("class_id").distinct(), "class_id", "left_semi").withColumn("filename", F.col("filepath"))
