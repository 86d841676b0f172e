"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back, both spread over the cluster;
tables are written between steps, so that lineage stays short and a lost
executor costs one step. The number of rounds grows with the logarithm of the
longest chain. No link or component reaches the driver, only a row count and a
checksum of each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _lowest(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(u, v, m) for links from u to v, m the lowest of u and of what it links to.

    The lowest are written first: a join straight behind its aggregation can't be split where one node has many links.
    """
    low = work.write(links.groupBy("u").agg(F.min("v").alias("m")), name)
    return links.join(low, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """links (u, v), both long and not null -> (u, m): the lowest node that each linked node reaches."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before, round_ = work.write(edges, f"{name}-0"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both, work, f"{name}-low").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.write(large, f"{name}-large")
        found = _lowest(large, work, f"{name}-low-2")
        small = found.select("u", F.col("m").alias("v")).unionByName(found.select(F.col("v").alias("u"), F.col("m").alias("v")))
        round_ += 1
        after = work.write(small.where("u <> v").distinct(), f"{name}-{round_}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(f"{name}-{round_ - 1}", f"{name}-low", f"{name}-large", f"{name}-low-2")
        edges = after
        if mark == before:
            return edges.select("u", F.col("v").alias("m"))
        before = mark
