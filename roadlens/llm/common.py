"""Shared helpers of the operators: reading tables, written intermediate tables, column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "read_table", "only"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Exactly the named columns under fixed names, so extra columns of the
    caller (also ones that clash with names used inside) never get in.

    ``only(df, doc_id="id", text="body")`` reads ``id`` and ``body``."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
