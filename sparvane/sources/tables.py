"""Tables in and out: CSV with headers, JSON, Parquet vectors, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .annotations import first_existing


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first of several Parquet vector tables that exists."""
    return spark.read.parquet(first_existing(spark, candidates))


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table of at most `most` rows; one line says so where there are more."""
    rows = df.limit(most + 1).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"The first {most} rows.")
    return "\n".join(lines) + "\n"


def summary_json(df: DataFrame) -> str:
    """A one-row summary as JSON."""
    row = df.first()
    return json.dumps(row.asDict() if row else {}, default=str, indent=2)
