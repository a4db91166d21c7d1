"""Images as rows, and descriptors from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..ship import ship

FLAT = "img_id int, height int, width int, rgb binary"


def read_images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, height, width, rgb): decoded by the JVM; files that don't decode are left out."""
    ship(spark)
    raw = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder)
    out = raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rgb = [_rgb(d, h, w, n) for d, h, w, n in zip(b["data"], b["height"], b["width"], b["n"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "height": b["height"], "width": b["width"], "rgb": rgb})

    return out.mapInPandas(turn, "path string, height int, width int, rgb binary")


def _rgb(data: bytes, height: int, width: int, channels: int) -> bytes:
    """The image source stores rows of BGR, BGRA or grey."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return (np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]).tobytes()


def state(photos: DataFrame) -> tuple:
    """Number and digest of the paths, lengths and times of change of the files in the folders that photos is read from; nothing is read of the files themselves."""
    folders = sorted({f.rsplit("/", 1)[0] for f in photos.inputFiles()})
    if not folders:
        return ()
    files = photos.sparkSession.read.format("binaryFile").load(folders).select("path", "length", F.col("modificationTime").alias("at"))
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "at"))).first())


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, length) of a folder's files of a kind, without their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def cropped(images: DataFrame, side: int = K.SIDE) -> DataFrame:
    """(img_id, height, width, rgb) of boxes cut out, resampled and mirrored; images has x, y, w, h and hflip too."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
                out.append((r.img_id, side, side, np.ascontiguousarray(K.box_image(rgb, r.x, r.y, r.w, r.h, side, bool(r.hflip))).tobytes()))
            yield pd.DataFrame(out, columns=["img_id", "height", "width", "rgb"])

    ship(images.sparkSession)
    return images.select("img_id", "height", "width", "rgb", "x", "y", "w", "h", "hflip").mapInPandas(run, FLAT)


def whole(images: DataFrame, side: int = K.SIDE) -> DataFrame:
    """(img_id, height, width, rgb) of whole images, resampled to a square."""

    def run(batches):
        for b in batches:
            out = [(r.img_id, side, side, K.resize(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3), side, side).tobytes()) for r in b.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["img_id", "height", "width", "rgb"])

    ship(images.sparkSession)
    return images.select("img_id", "height", "width", "rgb").mapInPandas(run, FLAT)


def extract(images: DataFrame, kernel: Callable[[K.Raster], np.ndarray], name: str = "vec") -> DataFrame:
    """(img_id, name): a vector for each image. An image that a kernel can't take gives no row and no failure."""

    def run(batches):
        for b in batches:
            ids, vecs = [], []
            for i, h, w, data in zip(b["img_id"], b["height"], b["width"], b["rgb"], strict=True):
                try:
                    vec = kernel(K.Raster(np.frombuffer(data, np.uint8).reshape(h, w, 3)))
                except (ValueError, TypeError, IndexError, ZeroDivisionError):
                    continue
                ids.append(i)
                vecs.append(np.asarray(vec, np.float32))
            yield pd.DataFrame({"img_id": np.array(ids, np.int32), name: pd.Series(vecs, dtype=object)})

    ship(images.sparkSession)
    return images.select("img_id", "height", "width", "rgb").mapInPandas(run, f"img_id int, `{name}` array<float>")


def tier1(images: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """img_id and 28 cattr_ columns; `ratios` has (img_id, bbox_ratio), 0 where it lacks an image."""
    names = list(K.attributes(K.Raster(np.zeros((8, 8, 3), np.uint8))))
    vec = extract(images, lambda r: np.array(list(K.attributes(r).values())), "v")
    wide = vec.select("img_id", *[F.get("v", i).cast("double").alias(n) for i, n in enumerate(names)])
    if ratios is None:
        return wide
    own = ratios.select("img_id", F.col("bbox_ratio").alias("_r"))
    return wide.join(own, "img_id", "left").withColumn("cattr_bbox_ratio", F.coalesce("_r", F.lit(0.0))).drop("_r")


def tier3(images: DataFrame) -> DataFrame:
    """img_id and hc_000 .. hc_255."""
    vec = extract(images, K.handcrafted, "v")
    return vec.select("img_id", *[F.get("v", i).alias(f"hc_{i:03d}") for i in range(256)])
