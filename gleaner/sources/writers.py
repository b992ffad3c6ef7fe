"""Sinks: Parquet tables, the year-partitioned interaction table, and run results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite", rebalance: bool = True) -> None:
    """Partition by year into evenly sized files.

    The rebalance hint lets a busy year spread over many tasks instead of one. Rows that lie in even
    partitions already, right behind a shuffle by (user, item), are written from these without it:
    a file for each partition and year, and the whole table is moved once less. Rows are
    sorted by time inside a file, so the time filters of the operators skip row groups.
    """
    even = df.hint("rebalance", F.col("year")) if rebalance else df
    (even.sortWithinPartitions("year", "ts")
     .write.mode(mode).option("compression", "zstd").partitionBy("year").parquet(path))


def save_results(results: DataFrame, path: str, run_id: str) -> None:
    """Store a run's long-form results under `run_id`; an existing run is never overwritten."""
    (results
     .write.mode("errorifexists").parquet(f"{path}/run_id={run_id}"))
