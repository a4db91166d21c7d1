"""Token-ID output: whole documents in ascending doc_id order, entropy-coded in segments.

Documents are range-partitioned and sorted by id; each task encodes its texts, and codes
runs of documents as segments (see rans.py) of about `segment_tokens` ids with a frequency
table of their own. A segment is a row (part, seq) of a Parquet table, whose writer commits
whole tasks, so retries and lost executors leave no half-written segments.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, ship
from .encoding import encoder
from .rans import Segment
from .rans import encode as encode_segment

_SEGMENT = "part int, seq int, n_tokens long, doc_ids array<long>, payload binary"


def _segments(definition, end_id: int, segment_tokens: int):
    def write(batches):
        part = TaskContext.get().partitionId()
        names = ["part", "seq", "n_tokens", "doc_ids", "payload"]
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = seq = 0

        def segment():
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([encode_segment(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            tool = encoder(definition.value)
            data, at = tool.encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                held.append(np.append(data[a:b], tool.dtype.type(end_id)))
                ids.append(doc_id)
                size += b - a + 1
                if size >= segment_tokens:
                    yield segment()
                    ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield segment()

    return write


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2, segment_tokens: int = 1 << 20) -> str:
    """Write the ids of every text, end_id after each document, and return where.

    `tokenizer` is a definition file of the tokenizers library, read on the driver. Ids are those of the
    library's call without added special tokens, so a text's own strings of special tokens give those. A null
    text is empty and has the end id alone. Null doc_ids come first; rows of one doc_id
    are ordered by text hash. No rows give a table without segments.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or shared_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    segments = rows.mapInArrow(_segments(definition, end_id, segment_tokens), _SEGMENT)
    segments.write.option("compression", "none").parquet(path)
    return path


def _documents(with_ids: bool):
    def read(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                s = Segment(row.column("payload")[0].as_py())
                ids = s.decode()
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                n = len(starts)
                columns = [
                    pa.array(np.full(n, row.column("part")[0].as_py(), np.int32)), pa.array(np.full(n, row.column("seq")[0].as_py(), np.int32)),
                    row.column("doc_ids")[0].values, pa.array(starts), pa.array(s.lengths),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return read


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with_ids also ids, decoded from a written table.

    start counts the ids of all documents before; segments' counts are summed over the
    parts and within each part, so neither list is longer than the files or one file's segments.
    """
    ship(spark)
    segments = spark.read.schema(_SEGMENT).parquet(path)
    counts = segments.select("part", "seq", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("_in")).join(parts, "part")
    schema = "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    docs = segments.select("part", "seq", "doc_ids", "payload").mapInArrow(_documents(with_ids), schema)
    out = docs.join(bases, ["part", "seq"])
    return out.select("doc_id", (F.col("_before") + F.col("_in") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
