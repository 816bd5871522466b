"""Scans in two levels: an order is cut into ranges, as many as the rows need, which are scanned apart and then put together.

No task holds more than a range of a key, however many rows the key has, and none of the results depends on where the
ranges are cut.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task scans.
ROWS = 1_000_000
#: Cuts that are found in the same pass in which the rows are counted; more rows than this times ROWS take another pass.
CUTS = 1000


def bounds(df: DataFrame, order: Column | str, rows: int = ROWS) -> list[float]:
    """Cuts of a number into ranges of about so many rows."""
    x = (F.col(order) if isinstance(order, str) else order).cast("double")
    at = lambda n: F.percentile_approx(x, F.array(*(F.lit(i / n) for i in range(1, n))), 10 * max(CUTS, n))
    n, cuts = df.agg(F.count(x), at(CUTS)).first()
    need = -(-n // rows)
    if need < 2:
        return []
    if need >= CUTS:
        cuts = df.agg(at(need)).first()[0]
    else:
        cuts = [cuts[i * CUTS // need - 1] for i in range(1, need)]
    return sorted(set(cuts))


def cuts_of(df: DataFrame, order: str, keys: tuple[str, ...], rows: int = ROWS) -> list[float]:
    """Cuts of an order within keys: none where every key fits a task, as then each is scanned whole and nothing has to be
    put together; else those of all rows."""
    if keys:
        most = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if most is None or most <= rows:
            return []
    return bounds(df, order, rows)


def range_of(order: Column | str, cuts: list[float]) -> Column:
    """How many cuts lie below a number. They are constants, so all branches of a plan agree, and are searched in two steps."""
    x = (F.col(order) if isinstance(order, str) else order).cast("double")
    below = lambda values: F.size(F.filter(values, lambda c: c < x))
    array = lambda values: F.array(*map(F.lit, values))
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if len(groups) == 1:
        return below(array(cuts))
    group = below(array([g[0] for g in groups]))
    return F.when(group == 0, 0).otherwise((group - 1) * step + below(F.element_at(F.array(*map(array, groups)), F.greatest(group, F.lit(1)))))


def running(df: DataFrame, order: str, sums: dict[str, Column], *keys: str, rows: int = ROWS, tie: tuple[str, ...] = ()) -> DataFrame:
    """run_x and total_x for each sum x: its running sum up to the row within the keys, and its sum over them. Rows equal
    in the order come by `tie`."""
    cuts = cuts_of(df, order, keys, rows)
    ranged = df.withColumn("range_", range_of(order, cuts))
    within = Window.partitionBy(*keys, "range_").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *(F.sum(c).over(within).alias(f"run_{x}") for x, c in sums.items()))
    if not cuts:
        whole = Window.partitionBy(*keys, "range_")
        return local.select("*", *(F.sum(c).over(whole).alias(f"total_{x}") for x, c in sums.items())).drop("range_")
    sizes = ranged.groupBy(*keys, "range_").agg(*(F.sum(c).alias(f"size_{x}") for x, c in sums.items()))  # a row a range
    key = list(keys) or [F.lit(0)]
    earlier, whole = Window.partitionBy(*key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    before = sizes.select(*keys, "range_", *(c for x in sums for c in (F.coalesce(F.sum(f"size_{x}").over(earlier), F.lit(0)).alias(f"before_{x}"), F.sum(f"size_{x}").over(whole).alias(f"total_{x}"))))
    out = local.join(before, [*keys, "range_"])
    for x in sums:
        out = out.withColumn(f"run_{x}", F.col(f"run_{x}") + F.col(f"before_{x}")).drop(f"before_{x}")
    return out.drop("range_")


def last_before(df: DataFrame, order: str, value: str, *keys: str, rows: int = ROWS, tie: tuple[str, ...] = ()) -> DataFrame:
    """Each row's last value that is not null, up to and with the row, as `last_`, within the keys."""
    cuts = cuts_of(df, order, keys, rows)
    ranged = df.withColumn("range_", range_of(order, cuts))
    within = Window.partitionBy(*keys, "range_").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("last_", F.last(value, ignorenulls=True).over(within))
    if not cuts:
        return local.drop("range_")
    place = F.when(F.col(value).isNotNull(), F.struct(order, *tie))
    ends = ranged.groupBy(*keys, "range_").agg(F.max_by(value, place).alias("end_"))
    key = list(keys) or [F.lit(0)]
    earlier = Window.partitionBy(*key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "range_", F.last("end_", ignorenulls=True).over(earlier).alias("carried_"))
    return local.join(carried, [*keys, "range_"]).withColumn("last_", F.coalesce("last_", "carried_")).drop("range_", "carried_")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_t: str, right_t: str, columns: list[str], tie: list[str] | None = None, strict: bool = True, rows: int = ROWS) -> DataFrame:
    """left with columns of the right row of the same keys that came last before it (or at the same time, if not strict);
    null if there is none. Of rows at one time the last by `tie` counts. Both sides are put into one order, so a key costs
    its rows and not their products. Null keys and times match nothing."""
    tie = tie or []
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    rest = [c for c in left.columns if c not in (*by, left_t)]
    full = lambda t: known & F.col(t).isNotNull()
    names = {c: f"tie{i}_" for i, c in enumerate(tie)}
    found = F.struct(*columns)
    held = right.where(full(right_t)).select(*by, F.col(right_t).alias("at_"), F.lit(0 if strict else -1).alias("side_"), *(F.col(c).alias(n) for c, n in names.items()), found.alias("found_"), F.lit(None).alias("row_"))
    asked = left.where(full(left_t)).select(*by, F.col(left_t).alias("at_"), F.lit(-1 if strict else 0).alias("side_"), *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names.items()), F.lit(None).alias("found_"), F.struct(F.lit(1).alias("one_"), *rest).alias("row_"))
    kind, row = held.schema["found_"].dataType, asked.schema["row_"].dataType
    both = held.withColumn("row_", F.col("row_").cast(row)).unionByName(asked.withColumn("found_", F.col("found_").cast(kind)))
    # times as numbers: microseconds of timestamps
    number = F.unix_micros(F.col("at_").cast("timestamp")) if both.schema["at_"].dataType.typeName().startswith("timestamp") else F.col("at_")
    both = both.withColumn("order_", number)
    out = last_before(both, "order_", "found_", *by, rows=rows, tie=("side_", *names.values())).where("row_ IS NOT NULL")
    clash = {c: f"right_{c}" if c in left.columns else c for c in columns}
    matched = out.select(*by, F.col("at_").alias(left_t), *(F.col(f"row_.{c}").alias(c) for c in rest), *(F.col(f"last_.{c}").alias(n) for c, n in clash.items()))
    alone = left.where(~full(left_t)).select(*by, left_t, *rest, *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in clash.items()))
    return matched.unionByName(alone)
