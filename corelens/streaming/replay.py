"""Replay of edge changes: a stream of (op, edge columns) keeps a stored index up to date, one version a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from corelens.plans.index import CoreIndex
from corelens.plans.maintain import apply_updates


def version_path(path: str, version: int) -> str:
    return f"{path}/v{version}"


def replay(changes: DataFrame, index_path: str, checkpoint: str, first_version: int = 0) -> StreamingQuery:
    """Start a query that applies each micro-batch of a stream (op `A` or `D`, and the model's edge columns) to the index.

    Version first_version must exist under index_path; micro-batch b reads version first_version + b and writes the one after, so
    a repeated micro-batch writes the same version again. In one batch, deletes come after adds.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        index = CoreIndex.load(spark, version_path(index_path, first_version + number))
        columns = index.graph.edges.columns
        adds, deletes = batch.where("op = 'A'").select(*columns), batch.where("op = 'D'").select(*columns)
        apply_updates(index, None if adds.isEmpty() else adds, None if deletes.isEmpty() else deletes).save(version_path(index_path, first_version + number + 1))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
