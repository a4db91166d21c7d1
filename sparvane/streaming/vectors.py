"""New vectors as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import normalized


def vector_stream(spark: SparkSession, folder: str, schema: str = "vec_id long, embedding array<float>") -> DataFrame:
    """A stream of Parquet vector files, unit length."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("embedding", normalized(F.col("embedding")))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to a Parquet table once, exactly once a row over restarts, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
