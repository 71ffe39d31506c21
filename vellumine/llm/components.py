"""Connected components by alternating large-star and small-star steps, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import table


def _min_join(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("mv")).select(F.col("u"), F.least("u", "mv").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """edges (u, v: long) -> (node, component): component is the least node reachable; only nodes of an edge appear.

    Self loops and repeated edges are harmless; no edges give no rows. The number of steps grows with the
    logarithm of the longest path; each step is a written table, so lost executors repeat one step only.
    """
    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_join(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _min_join(large)
        star = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = table(star.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    least = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return least.unionByName(roots.join(least.select("node"), "node", "left_anti"))
