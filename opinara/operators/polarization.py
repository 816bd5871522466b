"""Polarization of beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.scores import belief
from opinara.operators.scans import running


def beliefs(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot", "user_id", "stance", belief(F.col("mean")).alias("b"))


def symmetric(rows: DataFrame, group: str = "snapshot", user: str = "user_id", axis: str = "stance") -> DataFrame:
    """Sum of |b - mean of the axis| over users and axes, by 2 n."""
    mean = rows.groupBy(group, axis).agg(F.avg("b").alias("m"))
    users = rows.groupBy(group).agg(F.countDistinct(user).alias("n"))
    total = rows.join(mean, [group, axis]).groupBy(group).agg(F.sum(F.abs(F.col("b") - F.col("m"))).alias("s"))
    return total.join(users, group).select(group, F.round(F.col("s") / (2 * F.col("n")), 6).alias("polarization"))


def partitions(axes: int) -> list[int]:
    """All splits of the axes into two blocks, as masks of the block without the last axis."""
    return list(range(1, 2 ** (axes - 1)))


def asymmetric(rows: DataFrame, axes: list[str], group: str = "snapshot", user: str = "user_id", axis: str = "stance") -> DataFrame:
    """For each split: users' means over the block without the last axis, sorted; the greatest i * S_hi - (n - i) * S_lo
    over the places i, by 4 n squared. Equal means are merged first, so the sorted running sums have a row a value."""
    place = F.create_map(*(x for i, a in enumerate(axes) for x in (F.lit(a), F.lit(i))))
    bits = rows.withColumn("bit", F.pow(F.lit(2.0), place[F.col(axis)]).cast("int"))
    per = bits.withColumn("mask", F.explode(F.array(*map(F.lit, partitions(len(axes)))))).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    means = per.groupBy(group, "mask", user).agg(F.round(F.avg("b"), 9).alias("v"))
    values = means.groupBy(group, "mask", "v").agg(F.count("*").alias("c"))
    sums = running(values, "v", {"c": F.col("c"), "s": F.col("v") * F.col("c")}, group, "mask")
    n, s, i, low = (F.col(c) for c in ("total_c", "total_s", "run_c", "run_s"))
    # within equal values the expression is linear in i, so its greatest value is at the end of a run
    at = sums.select(group, "mask", n.alias("n"), (i * (s - low) - (n - i) * low).alias("e"))
    return at.groupBy(group, "mask").agg(F.round(F.max(F.col("e") / (4.0 * F.col("n") * F.col("n"))), 6).alias("polarization"))


def esteban_ray(rows: DataFrame, group: str = "snapshot", axis: str = "stance", bins: int = 10, alpha: float = 1.6, k: float = 1.0) -> DataFrame:
    """Beliefs in bins with middles as positions; the last bin takes 1."""
    n = rows.groupBy(group, axis, F.least(F.floor(F.round(F.col("b") * bins, 9)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("c"))
    total = Window.partitionBy(group, axis)
    p = n.select(group, axis, ((F.col("bin") + 0.5) / bins).alias("x"), (F.col("c") / F.sum("c").over(total)).alias("p"))
    q = p.select(group, axis, F.col("x").alias("x2"), F.col("p").alias("p2"))
    return p.join(q, [group, axis]).groupBy(group, axis).agg(F.round(k * F.sum(F.pow("p", F.lit(1 + alpha)) * F.col("p2") * F.abs(F.col("x") - F.col("x2"))), 6).alias("polarization"))
