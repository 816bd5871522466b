"""Scans, as-of joins, vector windows and reference points against plain Python, with ranges of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import movement, reference_points, scans, vector_windows
from opinara.sources import fixtures


def test_ranges_agree_with_their_cuts(spark):
    rows = spark.createDataFrame([(i * i % 997,) for i in range(997)], "x int")
    for size in (1, 10, 100, 400, 5000):
        cuts = scans.bounds(rows, "x", size)
        assert len(cuts) <= -(-997 // size)
        got = rows.select("x", scans.range_of("x", cuts).alias("r")).collect()
        assert all(r["r"] == sum(c < r["x"] for c in cuts) for r in got)
    assert max(spark.createDataFrame(got).groupBy("r").count().select("count").collect())[0] == 997
    assert scans.bounds(rows.limit(0), "x") == []


@pytest.mark.parametrize("rows", [5, 10**6])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, rows, strict):
    rng = random.Random(rows)
    left = [(i, rng.choice(["a", "b", "hub", "hub", None]), rng.choice([None, *range(40)])) for i in range(150)]
    right = [(i, rng.choice(["a", "hub", "hub", None, "z"]), rng.choice([None, *range(40)]), i % 7 or None) for i in range(120)]
    got = scans.asof(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "other int, k string, at int, v int"), ["k"], "t", "at", ["other", "v"], tie=["other"], strict=strict, rows=rows)
    assert got.columns == ["k", "t", "id", "other", "v"]
    found = {r["id"]: (r["other"], r["v"]) for r in got.collect()}
    assert len(found) == 150
    for i, k, t in left:
        before = [(at, o, v) for o, key, at, v in right if None not in (k, t, at) and key == k and (at < t or (at == t and not strict))]
        want = max(before, key=lambda x: x[:2])[1:] if before else (None, None)
        assert found[i] == want


@pytest.mark.parametrize("rows", [4, 10**6])
def test_vector_windows(spark, rows):
    rng = np.random.default_rng(3)
    content = [(["a", "b", "hub"][min(2, i % 7)], int(rng.integers(0, 60)), [float(x) for x in rng.normal(size=3)] if i % 11 else None) for i in range(200)]
    points = [(i, ["a", "b", "hub", "none"][i % 4], int(rng.integers(0, 70))) for i in range(80)]
    got = vector_windows.trailing_sums(spark.createDataFrame(points, "id int, k string, t int"), spark.createDataFrame(content, "k string, t int, e array<double>").repartition(3), "id", ["k"], "t", "e", 10, rows)
    found = {r["id"]: (r["n"], r["sum"]) for r in got.collect()}
    for i, k, t in points:
        own = [e for key, at, e in content if key == k and t - 10 < at < t and e is not None]
        if not own:
            assert i not in found
        else:
            assert found[i][0] == len(own) and np.allclose(found[i][1], np.sum(own, axis=0))
    before = vector_windows.sums_before(spark.createDataFrame(points, "id int, k string, t int"), spark.createDataFrame(content, "k string, t int, e array<double>"), ["k"], "t", "e", rows=rows).collect()
    assert len(before) == 80
    for r in before:
        own = [e for key, at, e in content if key == r["k"] and at < r["t"] and e is not None]
        assert r["n_before"] == len(own) and (np.allclose(r["sum_before"], np.sum(own, axis=0)) if own else r["sum_before"] is None)


@pytest.mark.parametrize("mode", ["instantaneous", "changepoint"])
def test_reference_points_do_not_depend_on_ranges(spark, sf_dir, mode):
    args = fixtures.interactions(spark, sf_dir), fixtures.posts(spark, sf_dir), fixtures.rings(spark, sf_dir), 50, mode
    whole = sorted(map(tuple, reference_points.reference_points(*args).collect()), key=str)
    cut = sorted(map(tuple, reference_points.reference_points(*args, rows=60).collect()), key=str)
    assert whole == cut and {r[1] for r in whole} == {"prev", "viewed", "global", "ring_1", "ring_2", "ring_3"}


def test_trailing_window_of_a_crowded_day(spark):
    rows = [("k", 1_700_000_000 + i % 50 * 3600, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "kind string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    a = sorted(map(tuple, movement.trailing(df, "kind", "ts", "v", 1).collect()), key=str)
    assert a == sorted(map(tuple, movement.trailing(df, "kind", "ts", "v", 1, rows_each=20).collect()), key=str)
    for _, s, _, _, n, mean in a:
        own = [v for _, at, v in rows if s - 86400 < at < s]
        assert n == len(own) and (mean is None if not own else abs(mean - sum(own) / n) < 1e-9)


def test_keys_that_fit_a_task_are_not_cut(spark):
    """Ranges follow from the rows of the largest key; many keys of few rows have none, and sums and values are the same."""
    few = spark.range(900).selectExpr("id % 90 AS g", "id AS o", "CASE WHEN id % 4 = 0 THEN id END AS v")
    hot = few.unionByName(spark.range(60).selectExpr("0L AS g", "id * 10 AS o", "id AS v"))
    assert scans.cuts_of(few, "o", ("g",), 20) == [] and len(scans.bounds(few, "o", 20)) > 30
    assert len(scans.cuts_of(hot, "o", ("g",), 20)) > 30 and len(scans.cuts_of(few, "o", (), 20)) > 30
    assert scans.cuts_of(few.limit(0), "o", ("g",), 20) == []
    for df in (few, hot):
        got = [sorted(map(tuple, scans.last_before(df, "o", "v", "g", rows=n, tie=("v",)).collect()), key=str) for n in (20, 10**6)]
        assert got[0] == got[1]
