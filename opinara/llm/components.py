"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node; no group is collected, so a hub is only a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk


def _is_star(edges: DataFrame, few: int) -> bool:
    """Whether every node has one edge down at most and none that leads on."""
    roles = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return roles.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").coalesce(few).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node it can reach) of every node that has a link to another."""
    edges = tk.checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    few = tk.parts(edges.count())  # rounds over few links are a matter of few tasks
    edges = edges.coalesce(few)
    while not _is_star(edges, few):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tk.checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few))
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct().coalesce(few)).coalesce(few)


def extended(roots: DataFrame, more: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """components() of the links that gave `roots` and of more, as a table. Of these only the roots count that they put
    together, each pair once, so links of a dense group cost what its components do, and earlier ones nothing."""
    few = tk.parts(more.count())
    edges = more.select(a, b)
    for c in (a, b):
        edges = edges.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root").coalesce(few)
    above = tk.checkpointed(components(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct().coalesce(few), a, b))
    many = tk.parts(roots.count())
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return tk.checkpointed(moved.unionByName(above.join(roots.select("node"), "node", "left_anti")).coalesce(many))
