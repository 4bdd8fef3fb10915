"""Connected components of a table of links, by alternating stars.

Large star: every node hands its larger neighbours to its smallest one.  Small star: every
node hands its smaller neighbours to the smallest.  Each step is two aggregations of one
number per node (partial sums first) and two joins that Spark may split at hot nodes; links
are written to the shared folder after each step, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tilth.session import staged


def _size(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _step(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node."""
    now = staged(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    size = _size(now)
    while size[0]:
        after = staged(_step(now), "links")
        grown = _size(after)
        now = after
        if grown == size:
            break
        size = grown
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.unionByName(roots)
