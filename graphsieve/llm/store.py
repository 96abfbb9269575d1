"""Tables of intermediate results, and what stages over long texts set in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphsieve.workspace import Scratch, new_path, remove, shared_dir, written

__all__ = ["Scratch", "new_path", "remove", "shared_dir", "small_batches", "written"]


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Few rows to an Arrow batch, as single texts can be long; this changes no result. It stays set in the session, as results are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
