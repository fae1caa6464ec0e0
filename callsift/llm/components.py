"""Connected components of an edge table by alternating large and small stars.

Each round points every node at the smallest node it knows of; rounds are
written tables, so a lost executor rereads them and no lineage grows. Nodes,
links and roots stay in tables. A hub's edges are pre-aggregated for its
minimum, and the join back may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsift.llm.work import Work


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(low, "u")
    return (out.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, work: Work, name: str = "star") -> DataFrame:
    """(node, root) for every node of an edge (u, v): root is the smallest
    node reachable. Self-loops count as no edge."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = work.table(e, f"{name}-0")
    before, n = None, 0
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, n = mark, n + 1
        e = work.table(_small_star(_large_star(e)), f"{name}-{n}")
        work.drop(f"{name}-{n - 1}")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
