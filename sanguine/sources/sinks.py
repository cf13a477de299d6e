"""Results to tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_results(results: DataFrame, path: str) -> None:
    """Overwrites; one directory a dataset."""
    results.write.mode("overwrite").partitionBy("dataset").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """One saved result table, or a directory of several."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path)


def save_matrix(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def print_errors(errors: DataFrame, n: int = 50) -> None:
    errors.show(n, truncate=False)
