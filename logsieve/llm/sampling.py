"""A bounded, repeatable sample of labelled rows for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's text modulo k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


#: Groups whose sizes are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def bounded_sample(labels: DataFrame, group: str, bound: int, seed: int = 11) -> DataFrame:
    """At most ``bound`` rows of each value of ``group`` (by a hash of doc_id)
    and the group's size as group_n. ``labels``: doc_id, group, no texts. All
    rows count; a hash threshold leaves little for the exact cut. The sizes are counted
    first and, being few, sent to the scan, so that the threshold cuts there and
    no group's rows meet in a task before it."""
    sizes = keep(labels.groupBy(group).agg(F.count("*").alias("group_n")), "group-sizes")
    if sizes.count() <= BROADCAST_GROUPS:
        sizes = F.broadcast(sizes)
    number = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    near = (labels.withColumn("number", number).join(sizes, group)
            .filter(F.col("number") * F.col("group_n") < F.lit(1.3 * bound + 60) * F.lit(1 << 30)))
    order = Window.partitionBy(group).orderBy("number", "doc_id")
    return near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= bound).drop("k", "number")
