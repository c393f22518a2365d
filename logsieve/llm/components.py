"""Connected components of a link table, by alternating large-star and
small-star steps (each a group-by and a join), cut by a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import keep


def _kept(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The written edges, and a checksum taken while they are written."""
    seen = Observation()
    edges = keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
    return edges, (seen.get["n"], seen.get["x"])


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v (long; any order, repeats and loops allowed). Returns
    node, root: each node with a link to another one, and the least node of its
    component. Ends when a round changes nothing."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges, before = _kept(links.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    while before[0]:
        # large star: a node's larger neighbours go to its least neighbour (or itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low_of, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low_of.select("u", F.col("m").alias("v")))
        edges, after = _kept(small.filter("u <> v").distinct(), "stars")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
