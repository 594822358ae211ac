"""Sinks and saved artefacts: CSV, Parquet, JSON lines and the history index
(fitted heads save themselves).  Paths are anything Spark can write to; a missing path raises
Spark's own error on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; array columns must have been joined before."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, UTF-8 kept, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def save_index(index: DataFrame, path: str) -> None:
    write_parquet(index, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
