"""Frames over time, windows without range joins, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.scans import ROWS, running


def past_and_future(df: DataFrame, user: str, t: str, value: str) -> DataFrame:
    """Mean of what came before, and of what comes from here on."""
    w = Window.partitionBy(user).orderBy(t)
    mean = lambda lo, hi: F.round(F.avg(value).over(w.rowsBetween(lo, hi)), 6)
    return df.withColumn("past_mean", mean(Window.unboundedPreceding, -1)).withColumn("future_mean", mean(0, Window.unboundedFollowing))


def trailing(df: DataFrame, kind: str, ts: str, value: str, days: int, rows_each: int = ROWS) -> DataFrame:
    """Count and mean of the same kind's rows in (ts - days, ts), as what came before ts less what came up to ts - days:
    running sums over one order of what is held and what is asked, so every row is read once and no task holds more than
    a range of a kind."""
    day = 86_400_000_000
    rows = df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    none = (F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("s"))
    # at equal times what is held comes before what is asked
    held = rows.select(kind, (F.col("__t") * 2).alias("at"), F.lit(0).alias("sign"), F.lit(None).cast("long").alias("of"), F.lit(1).cast("long").alias("c"), F.col(value).cast("double").alias("s"))
    times = rows.select(kind, "__t").distinct()
    asked = [times.select(kind, (at * 2 + 1).alias("at"), F.lit(sign).alias("sign"), F.col("__t").alias("of"), *none) for at, sign in ((F.col("__t") - 1, 1), (F.col("__t") - days * day, -1))]
    both = held.unionByName(asked[0]).unionByName(asked[1])
    ran = running(both, "at", {"c": F.col("c"), "s": F.col("s")}, kind, rows=rows_each).where("sign <> 0")
    sums = ran.groupBy(kind, F.col("of").alias("__t")).agg(F.sum(F.col("sign") * F.col("run_c")).alias("n_before"), F.sum(F.col("sign") * F.col("run_s")).alias("s_before"))
    out = rows.join(sums, [kind, "__t"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    return out.withColumn("mean_before", F.when(F.col("n_before") > 0, F.col("s_before") / F.col("n_before"))).drop("__t", "s_before")


def monthly(df: DataFrame, user: str, ts: str, value: str) -> DataFrame:
    """n and mean of each user's rows in each calendar month from the first to the last one that has some; months without
    rows have 0 and null. Rows are summed by month first, so the calendar meets a row a user and month."""
    month = F.date_trunc("month", F.col(ts)).cast("date")
    each = df.where(F.col(ts).isNotNull()).groupBy(user, month.alias("month")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    ends = each.groupBy(user).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    calendar = ends.select(user, F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return calendar.join(each, [user, "month"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def density(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and density of equal bins; hi belongs to the last bin, what lies outside is left out."""
    width = (hi - lo) / bins
    inside = df.select(value.alias("x")).where((F.col("x") >= lo) & (F.col("x") <= hi))
    counts = inside.select(F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", F.round(F.col("n") / (F.col("total") * width), 6).alias("density"))


def density_2d(df: DataFrame, x: Column, y: Column, bins: int) -> DataFrame:
    """Counts and density over a grid between the extremes of both axes."""
    rows = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("total"))
    width = lambda c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), width(c))), F.lit(bins - 1)), F.lit(0))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place("x").alias("bx"), place("y").alias("by")).agg(F.count("*").alias("n"), F.first(F.round(F.try_divide(F.lit(1.0), F.col("total") * width("x") * width("y")), 9)).alias("unit")).select("bx", "by", "n", F.round(F.col("n") * F.col("unit"), 6).alias("density"))


def log_histogram(df: DataFrame, value: Column, edges: int) -> DataFrame:
    """Counts in bins whose edges are evenly spaced on a log scale from 1 to the greatest value."""
    rows = df.select(value.alias("x")).where("x >= 1")
    top = rows.agg((F.ln(F.max("x")) / (edges - 1)).alias("step"))
    place = F.when(F.col("step") > 0, F.least(F.floor(F.round(F.ln("x") / F.col("step"), 9)), F.lit(edges - 2))).otherwise(0)
    return rows.crossJoin(F.broadcast(top)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def landmarks(hist: DataFrame) -> DataFrame:
    """First, last and fullest bin, and the rows within ten bins below the last."""
    ends = hist.agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.min_by("bin", F.struct(-F.col("n"), "bin")).alias("peak_bin"))
    return hist.crossJoin(F.broadcast(ends)).groupBy("first_bin", "last_bin", "peak_bin").agg(F.sum(F.when(F.col("bin") >= F.col("last_bin") - 10, F.col("n")).otherwise(0)).alias("n_most"))


def neighbour_window(interactions: DataFrame, content: DataFrame, ring: DataFrame, width: int) -> DataFrame:
    """What the neighbours of an interaction's author wrote in the `width` before it. interactions: content_id, author, t;
    content: author, t and more; ring: author, neighbour. Time is cut into buckets of the width, so an interaction meets two
    buckets of each neighbour and no rows outside them."""
    bucket = F.floor(F.col("t") / width)
    asked = interactions.join(ring, "author").select("content_id", "neighbour", F.col("t").alias("at"), F.explode(F.array(bucket - 1, bucket)).alias("bucket"))
    there = content.withColumn("bucket", bucket).withColumnRenamed("author", "neighbour").drop("content_id")
    return asked.join(there, ["neighbour", "bucket"]).where((F.col("t") >= F.col("at") - width) & (F.col("t") < F.col("at"))).drop("bucket", "at")
