"""The search store: images, attributes and vectors, as one Parquet table in index order or as a store of snapshots that grows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remove
from .relational import dense_ids


def build_store(metadata: DataFrame, attributes: DataFrame, vectors: DataFrame, path: str, attribute_columns: list[str] | None = None) -> DataFrame:
    """Write id, filename, species_id, species_name, attributes (JSON array), idx and embedding, replacing what was there.

    Only ids that all three tables have; idx counts them from 0 by id. The attributes are
    whole numbers, as values of 0/1 columns are.
    """
    names = attribute_columns or [c for c in attributes.columns if c.startswith(("attr_", "cattr_"))]
    values = attributes.select("img_id", F.to_json(F.array(*[F.col(c).cast("int") for c in names])).alias("attributes"))
    rows = metadata.select("img_id", "filename", F.col("class_id").alias("species_id"), F.col("class_name").alias("species_name"))
    rows = rows.join(values, "img_id").join(vectors.select("img_id", "embedding"), "img_id")
    indexed = dense_ids(rows, ["img_id"]).withColumnRenamed("img_id", "id")
    indexed.select("id", "filename", "species_id", "species_name", "attributes", "idx", "embedding").write.mode("overwrite").parquet(path)
    return open_store(metadata.sparkSession, path)


def open_store(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def as_table(df: DataFrame, name: str, buckets: int = 8) -> None:
    """A managed table, bucketed and sorted by idx for point lookups and joins by it."""
    df.write.mode("overwrite").bucketBy(buckets, "idx").sortBy("idx").saveAsTable(name)


def lookup(store: DataFrame, idx: int) -> DataFrame:
    return store.filter(F.col("idx") == idx).drop("embedding")


def check(store: DataFrame) -> DataFrame:
    """One row: rows, distinct indices, and the least and greatest vector length."""
    n = F.size("embedding")
    return store.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("idx").alias("indices"), F.min(n).alias("least_dim"), F.max(n).alias("most_dim"))


class Conflict(RuntimeError):
    """Another writer's snapshot came first; nothing of this one counts."""


@dataclass(frozen=True)
class Snapshot:
    """What a manifest says: which folder holds each bucket, the next index, and the last batch of each stream that is in it."""

    version: int
    schema: str
    buckets: dict[int, str]
    next_idx: int
    streams: dict[str, int] = field(default_factory=dict)


class Store:
    """Rows by id in buckets of Parquet files, with snapshots.

    A change writes new files of the buckets that it touches and then a manifest that names each bucket's folder. The manifest's number is
    the next one and is taken by a rename that fails where it exists: readers see the old snapshot until then, a crash before it leaves only files that
    no manifest names, and of two writers one gets a Conflict. Ids are unique; a row's `idx` is given when its id first comes, in order of id
    from the highest so far, and stays. Old snapshots can be read until `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        found = self.versions()
        if not found or (version is not None and version not in found):
            raise FileNotFoundError(f"no snapshot {'' if version is None else version} in {self.path}")
        lines = self.spark.read.text(f"{self.path}/manifests/{found[-1] if version is None else version:08d}.json", wholetext=True).first()[0]
        d = json.loads(lines)
        return Snapshot(d["version"], d["schema"], {int(k): v for k, v in d["buckets"].items()}, d["next_idx"], d["streams"])

    def _publish(self, new: Snapshot) -> None:
        draft, final = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/manifests/{new.version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"snapshot {new.version} of {self.path} is there already")

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, n: int) -> dict[int, str]:
        """Rows in a new folder, a folder of its own for each bucket; which bucket is where."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(n)).repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return {int(x.removeprefix("_bucket=")): f"{folder}/{x}" for x in found if x.startswith("_bucket=")}

    def create(self, rows: DataFrame, buckets: int = 8) -> Snapshot:
        """The first snapshot, of unique ids; idx counts them from 0 by id. Number and kinds of columns stay as they are here."""
        indexed = dense_ids(rows, [self.key])
        schema = indexed.schema.json()
        where = self._write(indexed, buckets)
        first = Snapshot(1, schema, {b: where.get(b, "") for b in range(buckets)}, indexed.count())
        self._publish(first)
        return first

    def read(self, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """A snapshot's rows, all or those of some buckets; other snapshots' files are never listed."""
        from pyspark.sql.types import StructType

        s = self.snapshot(version)
        paths = [f"{self.path}/{p}" for b, p in s.buckets.items() if p and (only is None or b in only)]
        schema = StructType.fromJson(json.loads(s.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, ids: Sequence) -> DataFrame:
        """The rows of some ids: only their buckets are read, and the ids go down to the scan."""
        s = self.snapshot()
        kind = next(f["type"] for f in json.loads(s.schema)["fields"] if f["name"] == self.key)
        asked = self.spark.createDataFrame([(x,) for x in ids], f"`{self.key}` {kind}")
        own = {r[0] for r in asked.select(self._bucket(len(s.buckets))).distinct().collect()}
        return self.read(s.version, sorted(own)).filter(F.col(self.key).isin(list(ids)))

    def change(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, stream: tuple[str, int] | None = None) -> Snapshot:
        """The next snapshot: rows of `deletes`' ids gone, then `upserts` put in place of rows of their ids or added. Only touched buckets are written anew.

        Of several upserts of one id any is taken, so they should be one. `stream` names a stream and its batch: a batch that is in the store already
        changes nothing, so a repeated one counts once.
        """
        s = self.snapshot()
        if stream and s.streams.get(stream[0], -1) >= stream[1]:
            return s
        n, names = len(s.buckets), [f["name"] for f in json.loads(s.schema)["fields"] if f["name"] != "idx"]
        rows = self.read(s.version)
        kinds = dict(rows.dtypes)
        new = upserts.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]).dropDuplicates([self.key]).persist() if upserts is not None else None
        gone = deletes.select(F.col(self.key).cast(kinds[self.key]).alias(self.key)).distinct().persist() if deletes is not None else None
        touched: set[int] = set()
        for df in (new, gone):
            touched |= {r[0] for r in df.select(self._bucket(n)).distinct().collect()} if df is not None else set()
        next_idx, buckets = s.next_idx, dict(s.buckets)
        if touched:
            kept = self.read(s.version, sorted(touched))
            if gone is not None:
                kept = kept.join(gone, self.key, "left_anti")
            if new is not None:
                known = kept.select(self.key, "idx")
                fresh = dense_ids(new.join(known, self.key, "left_anti").select(self.key), [self.key], "_n").withColumn("idx", F.col("_n") + next_idx).drop("_n").persist()
                next_idx += fresh.count()
                placed = new.join(known.unionByName(fresh.select(self.key, F.col("idx").cast(kinds["idx"]).alias("idx"))), self.key)
                kept = kept.join(new.select(self.key), self.key, "left_anti").unionByName(placed.select(kept.columns))
            where = self._write(kept, n)
            buckets |= {b: where.get(b, "") for b in touched}
        out = Snapshot(s.version + 1, s.schema, buckets, next_idx, s.streams | ({stream[0]: stream[1]} if stream else {}))
        self._publish(out)
        for df in (new, gone):
            if df is not None:
                df.unpersist()
        return out

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last `keep` manifests and every folder that none of those names; the number of deleted bucket folders."""
        found = self.versions()
        for v in found[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifests/{v:08d}.json"), False)
        named = {p for v in found[-keep:] for p in self.snapshot(v).buckets.values()}
        gone = 0
        for folder in self._fs.listStatus(self._hadoop(f"{self.path}/data")):
            own = [f.getPath().getName() for f in self._fs.listStatus(folder.getPath())]
            stale = [x for x in own if x.startswith("_bucket=") and f"data/{folder.getPath().getName()}/{x}" not in named]
            for x in stale:
                remove(self.spark, f"{self.path}/data/{folder.getPath().getName()}/{x}")
            gone += len(stale)
        return gone
