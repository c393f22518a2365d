"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.tables import spread, table

__all__ = ["keep", "spread", "table"]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    the lineage, is computed once, and survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kept/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
