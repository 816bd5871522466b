"""Activity, thresholds, deduplication, samples and splits. Samples follow from ids, so partitioning never changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.scans import running


def activity(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Count, first and last time and the days between them."""
    first, last = F.min(ts), F.max(ts)
    days = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(86_400_000_000)
    return events.groupBy(user).agg(F.count("*").alias("n"), first.alias("first_ts"), last.alias("last_ts"), F.round(days, 6).alias("duration_days"))


def topic_counts(events: DataFrame, user: str, topic: str, topics: list) -> DataFrame:
    """A column for each topic (0 without rows), their sum and the number of topics a user has."""
    wide = events.groupBy(user).pivot(topic, topics).count().fillna(0)
    some = sum((F.when(F.col(str(t)) > 0, 1).otherwise(0) for t in topics), F.lit(0))
    return wide.withColumn("n_all", sum((F.col(str(t)) for t in topics), F.lit(0))).withColumn("n_topics", some.cast("long"))


def active(events: DataFrame, least: int, *keys: str) -> DataFrame:
    """Rows of groups with more than `least` rows."""
    some = events.groupBy(*keys).count().where(F.col("count") > least).select(*keys)
    return events.join(some, list(keys), "left_semi")


def dedup_keyed(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order; min_by combines before the shuffle, so a hot key does no harm."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def scatter(id_col: str, m: int = 1000) -> Column:
    """An arithmetic hash of an id, 0 to m - 1."""
    return F.pmod(F.col(id_col) * F.lit(2654435761), F.lit(m))


def fraction(df: DataFrame, id_col: str, share: float) -> DataFrame:
    return df.where(scatter(id_col) < int(share * 1000))


def fixed_size(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """A sample of n rows: those with the least hash."""
    return df.orderBy(scatter(id_col, 1_000_003), id_col).limit(n)


def capped(df: DataFrame, group: str, id_col: str, cap: int) -> DataFrame:
    """At most `cap` rows of each group, by hash. Window group limits cut each partition before the shuffle."""
    w = Window.partitionBy(group).orderBy(scatter(id_col, 1_000_003), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("rank")


def numbered(df: DataFrame, order: str) -> DataFrame:
    """rn: the place of each row in the order of a number, from 1; no task sees all rows."""
    return running(df, order, {"n": F.lit(1).cast("long")}).withColumnRenamed("run_n", "rn").drop("total_n")


def systematic(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every (rows / n)-th row."""
    total = df.agg(F.greatest(F.floor(F.count("*") / n), F.lit(1)).alias("step"))
    return numbered(df, order).crossJoin(F.broadcast(total)).where((F.col("rn") - 1) % F.col("step") == 0).drop("step", "rn")


def ordered_split(df: DataFrame, order: str, train: int, dev: int) -> DataFrame:
    return numbered(df, order).withColumn("split", F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + dev, "dev").otherwise("test")).drop("rn")


def stratified_split(df: DataFrame, label: str, order: str, ratio: tuple[int, ...] = (6, 2, 2)) -> DataFrame:
    """Each label's rows in order: shares of ratio / 10, rounded down, for train and dev; the rest tests."""
    out = running(df, order, {"n": F.lit(1).cast("long")}, label)
    train, dev = F.floor(F.col("total_n") * ratio[0] / 10), F.floor(F.col("total_n") * ratio[1] / 10)
    split = F.when(F.col("run_n") <= train, "train").when(F.col("run_n") <= train + dev, "dev").otherwise("test")
    return out.withColumn("split", split).drop("run_n", "total_n")


def shuffled(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """rn: a place in an order that follows from the id and a seed."""
    key = F.pmod((F.col(id_col) + seed) * F.lit(2654435761), F.lit(1_000_003)) + F.pmod(F.col(id_col), F.lit(1 << 20)) / (1 << 21)
    return numbered(df.withColumn("key_", key), "key_").drop("key_")


def lookup_one(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """df with the columns of the one row of the table that has its keys; an error if there is none, or are several."""
    rest = [c for c in table.columns if c not in keys]
    found = table.groupBy(*keys).agg(F.count("*").alias("n_found"), *(F.first(c).alias(c) for c in rest))
    bad = F.raise_error(F.concat(F.lit("rows found for a key: "), F.coalesce("n_found", F.lit(0)).cast("string")))
    joined = df.join(found, list(keys), "left").withColumn("n_found", F.when(F.col("n_found") == 1, F.col("n_found")).otherwise(bad.cast("long")))
    return joined.where("n_found = 1").drop("n_found")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """same: whether both hold the same rows, equally often."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("same"))


def without_tombstones(df: DataFrame, author: str = "author") -> DataFrame:
    return df.where(F.col(author) != "[deleted]")


def rescale(step: Column, steps: int, start: int, end: int) -> Column:
    """Steps 0 to steps - 1 mapped evenly onto [start, end]."""
    return start + step * ((end - start) / (steps - 1))
