"""Connected components over an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v). Only the minimum of each neighbourhood is gathered, so a hub's links never meet in one row."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is its own minimum still links its larger neighbours, as above.
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, write: Written) -> DataFrame:
    """(u, v): every node that has a link, but for the smallest of its component, with that smallest node. `edges` has long columns u and v."""
    cur = write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = write(_star(_star(cur, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        write.drop(cur)
        cur = now
        if tuple(state) == seen:
            return cur
        seen = tuple(state)
