"""Sums of vectors over time windows, as differences of running sums.

Content and the points that ask about it are put into one order within their keys, and each range of it is read once as
a stream of Arrow batches: a running sum is kept, and a point takes it as it passes. What came in earlier ranges is added
by the same scan over the ranges' sums. Rows are never joined with rows, so a window may hold any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.scans import ROWS, bounds, range_of


def vector_sum(vector: str) -> Column:
    """An aggregate that combines before the shuffle."""
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vector).cast("array<double>"))))


def plus(a: str, b: str, sign: int = 1) -> Column:
    """Sum (or difference) of two vectors, null counting as zeros."""
    both = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.when(F.col(b).isNull(), F.col(a)).when(F.col(a).isNull(), F.transform(b, lambda y: sign * y)).otherwise(both)


def _stream(df: DataFrame, keys: list[str]) -> DataFrame:
    """df: keys, at, side, c, v, p (null for content). Of each row with a point: keys, p, and the running c and v."""
    n_keys = len(keys)
    schema = df.select(*keys, "p", "c", "v").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
            fresh = np.zeros(n, bool)
            for k in ids:
                fresh[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in ids)
            if first != last:
                count, total = 0, None
            v = b.column(b.schema.get_field_index("v"))
            held = v.is_valid().to_numpy(zero_copy_only=False)
            flat = v.filter(pa.array(held)).flatten().to_numpy(zero_copy_only=False)
            width = len(flat) // max(1, int(held.sum())) if len(flat) else 0 if total is None else len(total)
            each = np.zeros((n + 1, width))
            if len(flat):
                each[1:][held] = flat.reshape(-1, width)
            if total is not None and width:
                each[0] = total
            sums = np.cumsum(each, axis=0)
            counts = np.cumsum(np.concatenate([[count], b.column(b.schema.get_field_index("c")).to_numpy(zero_copy_only=False)]))
            starts = np.concatenate([[0], np.flatnonzero(fresh)])
            of = np.cumsum(fresh)
            # what had been summed before the key began; the first one goes on with what was carried
            base, base_n = sums[starts].copy(), counts[starts].copy()
            base[0], base_n[0] = 0, 0
            sums, counts = sums[1:] - base[of], counts[1:] - base_n[of]
            last, count, total = tuple(k[-1] for k in ids), int(counts[-1]), sums[-1].copy() if width else None
            p = b.column(b.schema.get_field_index("p"))
            asks = p.is_valid()
            at = np.flatnonzero(asks.to_numpy(zero_copy_only=False))
            if len(at):
                got = counts[at]
                some = got > 0 if width else np.zeros(len(at), bool)
                offsets = np.concatenate([[0], np.cumsum(np.where(some, width, 0))]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([~some, [False]])), pa.array(sums[at][some].ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).filter(asks) for i in range(n_keys)), p.filter(asks), pa.array(got.astype(np.int64)), out], [*keys, "p", "c", "v"])

    parts = df.select(*keys, "at", "side", "c", "v", "p").repartition(*keys).sortWithinPartitions(*keys, "at", "side")
    return parts.mapInArrow(run, schema)


def sums_before(points: DataFrame, content: DataFrame, by: list[str], t: str, vector: str, upto: str | None = None, rows: int = ROWS) -> DataFrame:
    """points with n_before and sum_before (null if there is nothing): number and sum of the vectors of content with the
    same keys and an earlier time; where the column `upto` is true, also those of the same time. Null keys, times and
    vectors match nothing; points that have them are left out."""
    known = F.col(t).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    p = F.struct(*points.columns)
    asked = points.where(known).select(*by, F.col(t).cast("double").alias("at"), (F.when(F.col(upto), 2).otherwise(0) if upto else F.lit(0)).alias("side"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("array<double>").alias("v"), p.alias("p"))
    held = content.where(known & F.col(vector).isNotNull()).select(*by, F.col(t).cast("double").alias("at"), F.lit(1).alias("side"), F.lit(1).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v"), F.lit(None).cast(asked.schema["p"].dataType).alias("p"))
    cuts = bounds(held, "at", rows)
    if not cuts:
        return _stream(held.unionByName(asked), by).select("p.*", F.col("c").alias("n_before"), F.col("v").alias("sum_before"))
    place = range_of("at", cuts).cast("double")
    held, asked = held.withColumn("range_", place), asked.withColumn("range_", place)
    near = _stream(held.unionByName(asked), [*by, "range_"])
    totals = held.groupBy(*by, "range_").agg(F.count("*").alias("c"), vector_sum("v").alias("v")).withColumn("side", F.lit(1)).withColumn("p", F.lit(None).cast("struct<one: int>"))
    wanted = asked.select(*by, "range_").distinct().select(*by, "range_", F.lit(0).cast("long").alias("c"), F.lit(None).cast("array<double>").alias("v"), F.lit(0).alias("side"), F.struct(F.lit(1).alias("one")).alias("p"))
    # a range is the time of its total, and the point of its totals asks before them
    ranges = totals.unionByName(wanted).withColumn("at", F.col("range_"))
    marked = ranges.withColumn("p", F.when(F.col("p").isNotNull(), F.struct(F.col("range_").alias("of"))))
    far = _stream(marked, by).select(*by, F.col("p.of").alias("range_"), F.col("c").alias("far_c"), F.col("v").alias("far_v"))
    return near.join(far, [*by, "range_"]).select("p.*", (F.col("c") + F.col("far_c")).alias("n_before"), plus("v", "far_v").alias("sum_before"))


def trailing_sums(points: DataFrame, content: DataFrame, key: str, by: list[str], t: str, vector: str, width: float, rows: int = ROWS) -> DataFrame:
    """key, n and sum of the content with the same keys in (t - width, t), for each point that has some; several points
    with one value of key are added up."""
    ends = points.select(key, *by, F.explode(F.array(F.struct(F.col(t).cast("double").alias("end"), F.lit(False).alias("upto"), F.lit(1).alias("sign")), F.struct((F.col(t).cast("double") - width).alias("end"), F.lit(True).alias("upto"), F.lit(-1).alias("sign")))).alias("e"))
    asked = ends.select(key, *by, F.col("e.end").alias(t), "e.upto", "e.sign")
    sums = sums_before(asked, content, by, t, vector, "upto", rows).where("n_before > 0")
    signed = sums.select(key, (F.col("sign") * F.col("n_before")).alias("n"), F.transform("sum_before", lambda x: x * F.col("sign")).alias("v"))
    return signed.groupBy(key).agg(F.sum("n").alias("n"), vector_sum("v").alias("sum")).where("n > 0")


def mean(total: str, n: str) -> Column:
    return F.transform(total, lambda x: x / F.col(n))
