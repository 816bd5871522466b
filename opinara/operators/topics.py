"""Topics: clusters of embeddings, fitted on a sample, with outliers and with topics inside topics.

k-means with parallel seeding: a few passes over the rows pick candidates in proportion to their squared distance from
those picked before; the candidates, weighted by the rows near them, give the first centroids. Lloyd steps then move the
centroids by sums that tasks form and Spark adds up. Many groups of rows can be clustered at once, each with centroids of
its own, which is how topics are clustered again. What comes to the driver are candidates and centroids, about
2 k SEED_ROUNDS vectors a group at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.graph import settled
from opinara.operators.scans import ROWS, running
from opinara.operators.vector_windows import vector_sum

SEED_ROUNDS = 4
OUTLIER = -1
Centroids = dict[int, np.ndarray]


def rows_of(df: DataFrame, id_col: str, vector: str, group: str | None = None) -> DataFrame:
    """id, g and v; rows without a vector or a group are left out."""
    g = F.col(group).cast("int") if group else F.lit(0)
    out = df.select(F.col(id_col).cast("long").alias("id"), g.alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return out.where("v IS NOT NULL AND g IS NOT NULL AND id IS NOT NULL")


def sample(rows: DataFrame, fraction: float) -> DataFrame:
    """Rows by the hash of their id."""
    return rows if fraction >= 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(fraction * 1_000_000))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((v * v).sum(1)[:, None] - 2 * v @ centroids.T + (centroids * centroids).sum(1), 0)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (ties to the first) and the distance to it. The product of matrices only chooses;
    distances are sums of squared differences, the same for equal rows wherever they stand."""
    near = squared(v, centroids)
    slack = 1e-12 * ((v * v).sum(1) + (centroids * centroids).sum(1).max())
    row, c = np.nonzero(~(near > (near.min(1) + slack)[:, None]))
    difference = v[row] - centroids[c]
    d = np.sqrt((difference * difference).sum(1))
    order = np.lexsort((c, d, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
    return c[first], d[first]


def _assigned(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """rows with c, the nearest of their group's centroids (ties to the first), and d, the distance to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 4096):
                part = f.iloc[i : i + 4096]
                c, d = np.full(len(part), -1, np.int32), np.zeros(len(part))
                group = part["g"].to_numpy()
                for g in np.unique(group):
                    if g in centroids:
                        own = group == g
                        c[own], d[own] = nearest(np.stack(part["v"].to_numpy()[own]), centroids[g])
                part = part.assign(c=c, d=d)
                yield part[part["c"] >= 0]

    return rows.select("id", "g", "v").mapInPandas(run, "id long, g int, v array<double>, c int, d double")


def seeds(rows: DataFrame, k: int, rounds: int = SEED_ROUNDS, least_share: float = 0.0) -> Centroids:
    """k first centroids of each group, or as many as it has different vectors among the candidates. Candidates that only
    stand for themselves, or for less than a tenth of least_share of the rows, are outliers and come after all others."""
    first = rows.groupBy("g").agg(F.min_by("v", F.struct(F.xxhash64("id"), "id")).alias("v")).collect()
    found = {r["g"]: [np.array(r["v"])] for r in first}
    for i in range(rounds):
        near = _assigned(rows, {g: np.stack(v) for g, v in found.items()})
        cost = near.groupBy("g").agg(F.sum(F.col("d") * F.col("d")).alias("cost"))  # a row a group
        chance = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1 << 40)) / float(1 << 40)
        drawn = near.join(F.broadcast(cost), "g").where(chance * F.col("cost") < 2 * k * F.col("d") * F.col("d"))
        for r in drawn.select("g", "id", "v").orderBy("g", "id").collect():  # about 2 k a group
            found[r["g"]].append(np.array(r["v"]))
    found = {g: np.unique(np.stack(v), axis=0) for g, v in found.items()}
    weights = {g: np.zeros(len(v)) for g, v in found.items()}
    for r in _assigned(rows, found).groupBy("g", "c").count().collect():
        weights[r["g"]][r["c"]] = r["count"]
    out = {}
    for g, v in found.items():
        crowd = weights[g] >= max(2, 0.1 * least_share * weights[g].sum())
        weights[g] = np.where(crowd, weights[g], weights[g] * 1e-9)
        chosen = [int(weights[g].argmax())]
        while len(chosen) < min(k, len(v)):  # the one that stands for the most cost so far
            left = weights[g] * squared(v, v[chosen]).min(1)
            if left.max() <= 0:
                break
            chosen.append(int(left.argmax()))
        out[g] = v[chosen]
    return out


def lloyd(rows: DataFrame, centroids: Centroids, rounds: int, tolerance: float = 1e-4) -> Centroids:
    """Centroids moved to the means of their rows, until none moves farther than the tolerance; one without rows stays."""
    for _ in range(rounds):
        near = _assigned(rows, centroids)
        sums = near.groupBy("g", "c").agg(F.count("*").alias("n"), vector_sum("v").alias("s")).collect()  # a row a centroid
        moved = {g: c.copy() for g, c in centroids.items()}
        for r in sums:
            moved[r["g"]][r["c"]] = np.array(r["s"]) / r["n"]
        shift = max((np.abs(moved[g] - centroids[g]).max() for g in centroids), default=0)
        centroids = moved
        if shift <= tolerance:
            break
    return centroids


def radii(rows: DataFrame, centroids: Centroids, quantile: float, each: int = ROWS) -> dict[tuple[int, int], tuple[int, float]]:
    """Of each group and centroid its rows and the least distance that the share `quantile` of them does not exceed. It is
    exact: rows are numbered in the order of their distance, in ranges of `each`."""
    near = settled(_assigned(rows, centroids).select("g", "c", "d"))
    ranked = running(near, "d", {"n": F.lit(1).cast("long")}, "g", "c", rows=each)
    share = Decimal(str(quantile))
    rank = F.greatest(F.ceil(F.col("total_n") * F.lit(share)), F.lit(1))
    got = ranked.where(F.col("run_n") == rank).select("g", "c", "total_n", "d").collect()  # a row a centroid
    return {(r["g"], r["c"]): (r["total_n"], r["d"]) for r in got}


class TopicModel:
    """Centroids and radii; topics of a group are numbered from 0, the one with most rows first."""

    def __init__(self, centroids: Centroids, sizes: dict[tuple[int, int], tuple[int, float]], least_share: float) -> None:
        self.centroids = centroids
        self.number: dict[tuple[int, int], int] = {}
        self.radius = {key: r for key, (_, r) in sizes.items()}
        for g in centroids:
            own = {c: n for (h, c), (n, _) in sizes.items() if h == g}
            total = sum(own.values())
            large = sorted((c for c, n in own.items() if n >= least_share * total), key=lambda c: (-own[c], c))
            self.number |= {(g, c): i for i, c in enumerate(large)}

    def transform(self, rows: DataFrame) -> DataFrame:
        """id, g, topic and distance. Topic -1: beyond the radius, or nearest to a cluster too small for a topic."""
        model = [(g, c, i, self.radius[g, c]) for (g, c), i in self.number.items()]
        known = rows.sparkSession.createDataFrame(model, "g int, c int, number int, radius double")
        near = _assigned(rows, self.centroids).join(F.broadcast(known), ["g", "c"], "left")
        return near.select("id", "g", F.when(F.col("d") <= F.col("radius"), F.col("number")).otherwise(OUTLIER).alias("topic"), F.col("d").alias("distance"))


def fit(rows: DataFrame, k: int, fraction: float = 1.0, rounds: int = 20, quantile: float = 0.95, least_share: float = 0.001, start: Centroids | None = None, trims: int = 1, tolerance: float = 1e-4) -> TopicModel:
    """Fits on a sample of the rows; `start` in place of seeds. After each of `trims` the centroids are moved once more,
    by the rows within their radius alone, so that outliers do not draw them."""
    some = settled(sample(rows, fraction))
    centroids = lloyd(some, seeds(some, k, least_share=least_share) if start is None else start, rounds, tolerance)
    for _ in range(trims):
        limits = [(g, c, r) for (g, c), (_, r) in radii(some, centroids, quantile).items()]
        near = _assigned(some, centroids).join(F.broadcast(rows.sparkSession.createDataFrame(limits, "g int, c int, radius double")), ["g", "c"])
        centroids = lloyd(settled(near.where("d <= radius").select("id", "g", "v")), centroids, rounds, tolerance)
    return TopicModel(centroids, radii(some, centroids, quantile), least_share)


def nested(rows: DataFrame, k: int, sub_k: int, fraction: float = 1.0, **settings: float) -> DataFrame:
    """id, topic, subtopic: all rows by the topics of a sample, and each topic's rows by topics of their own."""
    top = settled(fit(rows, k, fraction, **settings).transform(rows).select("id", "topic"))
    inside = settled(rows.drop("g").join(top.where(F.col("topic") >= 0), "id").select("id", F.col("topic").alias("g"), "v"))
    below = fit(inside, sub_k, fraction, **settings).transform(inside)
    return top.join(below.select("id", F.col("topic").alias("subtopic")), "id", "left").withColumn("subtopic", F.coalesce("subtopic", F.lit(OUTLIER)))
