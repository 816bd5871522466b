"""Opinions of users over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.scores import half_life


def moments(df: DataFrame, *keys: str, value: str = "predicted") -> DataFrame:
    """n, mean and population variance, from exact sums."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*keys, "n", mean.alias("mean"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"))


def certainty_mean(df: DataFrame, *keys: str) -> DataFrame:
    """Mean of means weighted by exp(-variance)."""
    w = F.exp(-F.col("variance"))
    return df.groupBy(*keys).agg(F.count("*").alias("n_users"), F.round(F.avg("mean"), 6).alias("mean_opinion"), F.round(F.sum(F.col("mean") * w) / F.sum(w), 6).alias("weighted_mean"))


def precision_mean(df: DataFrame, profiles: DataFrame, *keys: str) -> DataFrame:
    """Mean and variance with each observation weighted by its classifier's precision on the class it predicted."""
    total = profiles.groupBy("classifier_id", "predicted").agg(F.sum("prob").alias("total"))
    hit = profiles.where("actual = predicted").select("classifier_id", "predicted", "prob")
    precision = hit.join(total, ["classifier_id", "predicted"]).select("classifier_id", "predicted", (F.col("prob") / F.col("total")).alias("w"))
    rows = df.join(F.broadcast(precision), ["classifier_id", "predicted"])
    mean = F.sum(F.col("predicted") * F.col("w")) / F.sum("w")
    return rows.groupBy(*keys).agg(F.round(mean, 6).alias("mean"), F.round(F.sum(F.col("predicted") * F.col("predicted") * F.col("w")) / F.sum("w") - mean * mean, 6).alias("variance"))


def smoothed(df: DataFrame, end: str, half: float, *keys: str) -> DataFrame:
    """Mean with weights that halve every `half` days before `end`."""
    age = (F.unix_micros(F.lit(end).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000)
    w = half_life(age, half)
    return df.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")).groupBy(*keys).agg(F.round(F.sum(F.col("predicted") * w) / F.sum(w), 6).alias("smoothed"))


def prefixes(df: DataFrame, ends: list[str], *keys: str) -> DataFrame:
    """Moments of all that lies before each of a few ends: each row is counted in its own stretch and stretches are summed
    up, so no row is repeated."""
    bound = [F.lit(e).cast("timestamp_ntz") for e in ends]
    stretch = sum((F.when(F.col("ts") >= b, 1).otherwise(0) for b in bound), F.lit(0))
    sums = df.withColumn("stretch", stretch).where(F.col("stretch") < len(ends)).groupBy(*keys, "stretch").agg(F.count("*").alias("n"), F.sum("predicted").alias("s"))
    grid = sums.groupBy(*keys).agg(F.min("stretch").alias("lo")).select(*keys, F.explode(F.sequence("lo", F.lit(len(ends) - 1))).alias("stretch"))
    w = Window.partitionBy(*keys).orderBy("stretch")
    full = grid.join(sums, [*keys, "stretch"], "left").select(*keys, "stretch", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"), F.sum(F.coalesce("s", F.lit(0))).over(w).alias("s"))
    return full.select(*keys, F.element_at(F.array(*(F.lit(e) for e in ends)), F.col("stretch") + 1).alias("until"), "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


def ranges(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("user_id", "stance").agg((F.max("mean") - F.min("mean")).alias("range"))


def top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def displacement(snapshots: DataFrame, n_stances: int) -> DataFrame:
    """Greatest Euclidean move of each user between two snapshots in which all stances are known, and which two."""
    a = snapshots.select("user_id", "stance", F.col("snapshot").alias("s1"), F.col("mean").alias("m1"))
    b = snapshots.select("user_id", "stance", F.col("snapshot").alias("s2"), F.col("mean").alias("m2"))
    pairs = a.join(b, ["user_id", "stance"]).where("s1 < s2").groupBy("user_id", "s1", "s2").agg(F.count("*").alias("known"), F.sqrt(F.sum(F.pow(F.col("m1") - F.col("m2"), F.lit(2.0)))).alias("d"))
    full = pairs.where(F.col("known") == n_stances).withColumn("d", F.round("d", 6))
    return full.groupBy("user_id").agg(F.min_by(F.struct("s1", "s2", "d"), F.struct(-F.col("d"), "s1", "s2")).alias("x")).select("user_id", "x.*")


def transitions(df: DataFrame, *by: str) -> DataFrame:
    """Share of each next prediction after each one, in the order of a user's rows (ts, event_id)."""
    w = Window.partitionBy("user_id", "stance").orderBy("ts", "event_id")
    steps = df.withColumn("next", F.lead("predicted").over(w)).where("next IS NOT NULL")
    counts = steps.groupBy(*by, "predicted", "next").agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by, "predicted")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(total))


def frobenius(shares: DataFrame, *by: str) -> DataFrame:
    """Distance of each 3 x 3 transition matrix from the identity; cells without rows are 0."""
    square = F.sum(F.pow(F.col("share") - F.when(F.col("predicted") == F.col("next"), 1.0).otherwise(0.0), F.lit(2.0)))
    stay = F.lit(3.0) - F.count_if(F.col("predicted") == F.col("next"))
    return shares.groupBy(*by).agg(F.round(F.sqrt(square + stay), 6).alias("movement"))


def classifier_shares(df: DataFrame) -> DataFrame:
    n = df.groupBy("stance", "predicted", "classifier_id").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("stance", "predicted")))


def emission(shares: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each target and true class the probability of each prediction, classifiers blended by their shares."""
    p = profiles.withColumnRenamed("predicted", "said").withColumnRenamed("actual", "predicted")
    return shares.join(F.broadcast(p), ["classifier_id", "predicted"]).groupBy("stance", "predicted", "said").agg(F.round(F.sum(F.col("share") * F.col("prob")), 6).alias("prob"))
