"""The whole build: annotations and images to a search store, each step kept under a key of its inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOT_SEARCHED, Config
from ..functions import kernels
from ..operators import fitting, relational, retrieval, statistics, store
from ..sources import annotations, images, tables
from . import posture
from .blocklist import BLOCKED


class Steps:
    """Named results under a folder. A step is reused where its key (name, settings, keys of its inputs) is already there."""

    def __init__(self, spark: SparkSession, folder: str, reuse: bool = True, rebuild: Sequence[str] = ()):
        self.spark, self.folder, self.reuse, self.rebuild = spark, folder.rstrip("/"), reuse, set(rebuild)
        self.made: list[str] = []

    def __call__(self, name: str, settings: object, inputs: Sequence[object], make: Callable[[], DataFrame]) -> DataFrame:
        """inputs are results of other steps, which stand for their keys, or values that identify what comes from outside."""
        of = [getattr(i, "_sparvane_step", i) for i in inputs]
        key = hashlib.sha256(repr((name, settings, of)).encode()).hexdigest()[:16]
        path = f"{self.folder}/{name}-{key}"
        if not (self.reuse and name not in self.rebuild and annotations.exists(self.spark, f"{path}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        out = self.spark.read.parquet(path)
        out._sparvane_step = (name, key)
        return out


def fused(
    blocks: dict[str, DataFrame], weights: dict[str, float], dims: dict[str, int] | None = None, boost: tuple[Sequence[int], float] = ((), 1.0), pool: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """(img_id, vec): each tier PCA-reduced where asked, z-scored, the first one boosted, all weighted and joined.

    PCA and z-scores come from the pool's tiers where there is a pool, else from the tiers themselves.
    """
    out = None
    for i, (name, df) in enumerate(blocks.items()):
        own, ref = (x.select("img_id", F.col("vec").cast("array<double>").alias("vec")) for x in (df, (pool or blocks)[name]))
        model = fitting.fit_pca(ref, "vec", (dims or {}).get(name, 0))
        own, ref = (fitting.apply_pca(x, "vec", model, "vec") for x in (own, ref))
        own = statistics.zscore_vectors(own, "vec", ref)
        if i == 0:
            own = own.withColumn("vec", retrieval.boost(F.col("vec"), *boost))
        own = own.select("img_id", F.col("vec").alias(name))
        out = own if out is None else out.join(own, "img_id")
    return out.select("img_id", retrieval.fuse({n: weights[n] for n in blocks}).alias("vec"))


def build(spark: SparkSession, config: Config, photos: DataFrame, out: str, blocked: Sequence[str] = BLOCKED) -> dict[str, DataFrame]:
    """photos: (filepath, height, width, rgb). Gives metadata, tier1, tier2, tier3, fused, prototypes and store.

    With full_pool, tier 2 is fitted on whole photos of all images of the kept classes, and
    PCA and z-scores of the fusion come from them, or from a sample in proportion to the classes
    (stat_rows); only kept images go into the store. Each step's key holds its settings and its inputs' keys,
    down to the lengths and times of the annotation files and the photos, and the plan that gives the photos.
    """
    t = annotations.load(spark, config.root)
    steps = Steps(spark, out, config.reuse, config.rebuild)
    files, shots = annotations.state(spark, config.root), (photos.semanticHash(), *images.state(photos))

    def metadata() -> DataFrame:
        ids = posture.attribute_ids(t["attributes"])
        names = spark.createDataFrame([(b,) for b in blocked], "filename string")
        chosen = posture.selected(posture.scored(t["master"], t["attribute_labels"], t["parts"], ids), names, least=config.min_images, relax=config.relax)
        return posture.facing(chosen, t["parts"], t["master"])

    meta = steps("metadata", (config.min_images, config.relax, tuple(blocked)), [files], metadata)
    raw = lambda df: df.join(photos, "filepath")
    crops = steps("crops", (), [meta, shots], lambda: images.cropped(raw(meta).select("img_id", photos["height"].alias("height"), photos["width"].alias("width"), "rgb", "x", "y", meta["width"].alias("w"), meta["height"].alias("h"), "hflip")))
    one = steps("tier1", (), [crops, meta], lambda: images.tier1(crops, meta.select("img_id", "bbox_ratio")))
    three = steps("tier3", (), [crops], lambda: images.extract(crops, kernels.handcrafted))

    pool = crops
    if config.full_pool:
        every = annotations.fit_pool(t["master"], meta)
        pool = steps("pool", (), [meta, shots], lambda: images.whole(raw(every.select("img_id", "filepath")).select("img_id", "height", "width", "rgb")))

    def model() -> DataFrame:
        place = meta.select("img_id", F.col("x").alias("bbox_x"), F.col("y").alias("bbox_y"), F.col("width").alias("bbox_w"), F.col("height").alias("bbox_h"))
        boxes = fitting.fit_boxes(t["parts"], place)
        return fitting.tier2_table(spark, fitting.fit_tier2(pool, boxes, config.profile, config.dims, config.fit_rows))

    fitted = steps("tier2-model", (config.speed, config.dims, config.fit_rows), [pool, meta], model)
    tier2 = steps("tier2", (), [crops, fitted], lambda: fitting.encode_tier2(crops, fitting.tier2_of(fitted)))
    names = [c for c in one.columns if c.startswith("cattr_") and c not in NOT_SEARCHED]
    blocks = {"t1": one.select("img_id", F.array(*names).alias("vec")), "t2": tier2.select("img_id", F.col("embedding").alias("vec")), "t3": three}
    tiers, reference = [one, tier2, three], None
    if config.full_pool:
        kept = relational.stratified_sample(every.select("img_id", "class_id"), "class_id", "img_id", config.stat_rows) if config.stat_rows else every
        shown = steps("pool-sample", config.stat_rows, [pool], lambda: pool.join(kept.select("img_id"), "img_id", "left_semi"))
        first = steps("pool-tier1", (), [shown], lambda: images.tier1(shown))
        second = steps("pool-tier2", (), [shown, fitted], lambda: fitting.encode_tier2(shown, fitting.tier2_of(fitted)))
        third = steps("pool-tier3", (), [shown], lambda: images.extract(shown, kernels.handcrafted))
        reference = {"t1": first.select("img_id", F.array(*names).alias("vec")), "t2": second.select("img_id", F.col("embedding").alias("vec")), "t3": third}
        tiers += [first, second, third]
    hu = [names.index(f"cattr_hu{i}") for i in (1, 2, 3)]
    settings = (config.weights, config.hu_weight, config.pca_dim)
    both = steps("fused", settings, tiers, lambda: fused(blocks, dict(zip(("t1", "t2", "t3"), config.weights, strict=True)), {"t2": config.pca_dim}, (hu, config.hu_weight), reference))
    labelled = tier2.join(meta.select("img_id", "class_id"), "img_id")
    return {
        "metadata": meta, "tier1": one, "tier2": tier2, "tier3": three, "fused": both,
        "prototypes": retrieval.prototypes(labelled, "class_id"), "store": store.build_store(meta, one, tier2, f"{out.rstrip('/')}/store"),
    }


def search(images: DataFrame, query_id: int | None = None, k: int = 5, metric: str = "cosine") -> DataFrame:
    """The store's k nearest rows to one of its rows (by default the lowest id), which is among them."""
    row = (images.orderBy("id") if query_id is None else images.filter(F.col("id") == query_id)).select("embedding").first()
    if row is None:
        raise LookupError(f"no image {query_id}")
    hits = retrieval.top_k(images, list(np.asarray(row[0], float)), k, "id", metric=metric)
    return retrieval.with_metadata(hits, images.drop("embedding"), "id").orderBy("rank")


def report(meta: DataFrame) -> str:
    """Counts of a filtered set, as Markdown."""
    per = meta.groupBy("class_name").agg(F.count(F.lit(1)).alias("images"))
    return tables.markdown(per.agg(F.sum("images").alias("images"), F.count(F.lit(1)).alias("species"), F.bround(F.avg("images"), 4).alias("mean"), F.min("images").alias("least"), F.max("images").alias("most")), "Filtered set")
