"""Sinks: measured series and statistics as JSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_series(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Append measured runs (one dict each) as JSON lines; keys must be the same in all."""
    if rows:
        names = list(rows[0])
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names).coalesce(1).write.mode("append").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
