"""Centroids, distances and neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.scores import cosine, euclidean
from opinara.operators.graph import settled

#: Links of a task, and the most keys of content whose sums are broadcast.
LINKS, MOST_BROADCAST = 100_000, 10_000


def centroids(df: DataFrame, *keys: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """Mean vector of each key as (key, pos, value) rows."""
    rows = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return rows.groupBy(*keys, "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("value"))


def linked_centroids(links: DataFrame, content: DataFrame, key: str, by: str, vector: str = "embedding", digits: int = 6, each: int = LINKS) -> DataFrame:
    """What `centroids` gives by `key` for distinct links (key, by) joined with content by `by`. Content is summed for each
    `by` first; links are dealt by key, about `each` to a task, so a task holds the sums of its own keys alone."""
    cells = content.where(F.col(by).isNotNull()).select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    sums = settled(cells.groupBy(by).agg(F.collect_list(F.struct("pos", "s", "n")).alias("cells")))  # the places of a vector
    links = settled(links.select(key, by).where(F.col(by).isNotNull()).distinct())
    parts = max(1, -(-links.count() // each))
    if sums.count() <= MOST_BROADCAST:
        joined = links.repartition(parts, key).join(F.broadcast(sums), by)
    else:
        joined = links.join(sums, by).repartition(parts, key)
    rows = joined.select(key, F.explode("cells").alias("c")).select(key, "c.pos", "c.s", "c.n")
    return rows.groupBy(key, "pos").agg(F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), digits).alias("value"))


def assemble(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, pos, value) rows as one array a key."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("centroid"))


def nearest(df: DataFrame, cents: DataFrame, key: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """The nearest of a few centroids for each row; ties go to the least key. The centroids are one small array."""
    few = cents.agg(F.array_sort(F.collect_list(F.struct(key, "centroid"))).alias("all"))
    best = F.array_min(F.transform("all", lambda c: F.struct(F.round(euclidean(F.col(vector), c["centroid"]), 4).alias("distance"), c[key].alias(key))))
    return df.crossJoin(F.broadcast(few)).withColumn("best", best).select(id_col, F.col(f"best.{key}").alias(key), F.col("best.distance").alias("distance"))


def with_previous(df: DataFrame, user: str, t: str, *columns: str) -> DataFrame:
    """Each row with columns of the same user's row before it."""
    w = Window.partitionBy(user).orderBy(t)
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def reference_distances(df: DataFrame, user: str, prev: str, *others: str, digits: int = 4) -> DataFrame:
    """Distance and similarity of each reference vector to the user's and to the user's previous one."""
    return df.select("*", *(f(F.col(base), F.col(o)).alias(f"{name}_{n}_{o}") for o in others for n, base in (("user", user), ("prev", prev)) for name, f in (("dist", lambda a, b: F.round(euclidean(a, b), digits)), ("cos", lambda a, b: F.round(cosine(a, b), digits)))))
