"""Shingles that many sets hold come last in the order before any list is shuffled."""

import numpy as np

from opinara.llm import jaccard
from tests.llm.test_brute_force import same_components


def _texts():
    """Near copies of a text, a chain of them, and others that share a passage."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocabulary, 40))
    texts, base = {}, list(rng.choice(vocabulary, 90))
    for i in range(60):
        base[rng.integers(len(base))] = f"new{i}"
        texts[i] = " ".join(base)
        texts[100 + i] = common + " " + " ".join(rng.choice(vocabulary, rng.integers(4, 60)))
        texts[200 + i] = common + " tail" * (i % 3)
    return texts


def test_order_by_frequency_loses_no_link(spark):
    """With all shingles of three sets or more last, with and without renewals, against all pairs."""
    for renewal in (0.0, 1e9):
        same_components(spark, _texts(), long=3, renewal=renewal, sample=1)


def test_no_list_is_shuffled_twice_for_what_a_sample_shows(spark, monkeypatch):
    """A passage of all texts makes no renewal, for which all entries would be shuffled again, at any size of the input."""
    renewed, without = [], jaccard._without
    monkeypatch.setattr(jaccard, "_without", lambda *a: renewed.append(1) or without(*a))
    same = " ".join(f"s{i}" for i in range(40))
    for n in (400, 1600):
        texts = [f"{same} " + " ".join(f"w{k}x{i}" for i in range(100)) for k in range(n)]
        texts += [f"{texts[0]} end", f"{texts[1]} end", f"{texts[1]} other end"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
        assert got == {k: k for k in range(n)} | {n: 0, n + 1: 1, n + 2: 1}
    assert not renewed


def test_rows_that_stay_are_not_shuffled(spark, sf_dir):
    """Of rows of which few go and few repeat, keep_one shuffles the repeated ones alone, not the texts of all."""
    texts = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(50)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(7, texts[7], "x"), (60, texts[3], "y"), (None, texts[4], "z"), (None, "alone in the world", "z"), (None, None, "z")]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema)
    got = jaccard.keep_one(spark, docs, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*rows[:50], *rows[53:]], key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = jaccard.keep_one(spark, spark.createDataFrame(rows[:50], schema), sf_dir)
    assert got.count() == 50 and "hashpartitioning(row_key" not in got._jdf.queryExecution().executedPlan().toString()
