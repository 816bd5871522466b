"""Topics, principal components and the classifier against NumPy and against what was planted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import classifier, reduction, topics
from opinara.plans import learned


def planted(spark, n=600, k=5, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, 6)) * 10
    of = np.minimum(rng.integers(0, 2 * k, n), k - 1)  # one cluster holds more than half of all rows
    x = centres[of] + rng.normal(size=(n, 6)) * 0.5
    x[:6] += 300 * np.eye(6)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, (n, None)], "id int, e array<double>"), x, of


def test_topics_are_the_planted_clusters(spark):
    df, _, of = planted(spark)
    rows = topics.rows_of(df, "id", "e")
    got = {r["id"]: r["topic"] for r in topics.fit(rows, 5, fraction=0.6, quantile=0.95, least_share=0.02).transform(rows).collect()}
    assert len(got) == 600
    assert all(got[i] == -1 for i in range(6))
    inside = [(of[i], got[i]) for i in range(6, 600) if got[i] >= 0]
    assert len(inside) > 0.88 * 594
    assert len({t for _, t in inside}) == 5 and len(set(inside)) == 5  # one topic a cluster
    sizes = np.bincount([t for _, t in inside])
    assert sizes.argmax() == 0


def test_partitioning_does_not_change_topics(spark):
    df, _, _ = planted(spark)
    fit = lambda d: sorted(map(tuple, topics.fit(topics.rows_of(d, "id", "e"), 5).transform(topics.rows_of(d, "id", "e")).select("id", "topic").collect()))
    assert fit(df.repartition(1)) == fit(df.repartition(7, "id"))


def test_lloyd_steps(spark):
    df, x, _ = planted(spark)
    rows = topics.rows_of(df, "id", "e")
    want = x[[10, 20, 30, 40]]
    got = topics.lloyd(rows, {0: want.copy()}, 3, 0)[0]
    for _ in range(3):
        near = ((x[:, None] - want) ** 2).sum(2).argmin(1)
        want = np.array([x[near == c].mean(0) if (near == c).any() else want[c] for c in range(4)])
    assert np.allclose(got, want)


@pytest.mark.parametrize("each", [7_000, 10**6])
def test_radii_are_exact_quantiles(spark, each):
    rows = spark.range(60_001).selectExpr("id", "0 AS g", "array(pow(cast(id AS double), 1.5), 0D) AS v")
    (n, r), = topics.radii(rows, {0: np.zeros((1, 2))}, 0.95, each).values()
    assert (n, r) == (60_001, pytest.approx(57_000**1.5, rel=1e-12))  # 0.95 of 60,001 rows are 57,000.95, so 57,001 of them


def test_copies_are_equally_far(spark):
    """Equal rows get one distance, and equal centroids leave all rows to the first."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5, 64))
    c = np.concatenate([rng.normal(size=(9, 64)), v[:1] * 0.9])
    c[3] = c[9]
    of, d = topics.nearest(v[np.arange(5001) % 5], c)
    assert all(len(set(d[i::5])) == 1 and len(set(of[i::5])) == 1 for i in range(5))
    assert of[0] == 3 and np.allclose(d[:5], np.sqrt(((v[:, None] - c) ** 2).sum(2)).min(1))


def test_topics_within_topics(spark):
    rng = np.random.default_rng(0)
    centre = np.array([[0, 0], [0, 4], [100, 0], [100, 4]], float)
    x = centre[np.arange(400) % 4] + rng.normal(size=(400, 2)) * 0.2
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id int, e array<double>")
    got = topics.nested(topics.rows_of(df, "id", "e"), 2, 2, quantile=1.0).collect()
    assert len(got) == 400 and len({(r["id"] % 4, r["topic"], r["subtopic"]) for r in got}) == 4


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "id int, e array<double>")
    rows = topics.rows_of(df, "id", "e")
    assert {(r["id"], r["topic"]) for r in topics.fit(rows, 5).transform(rows).collect()} == {(1, 0), (2, 0)}
    assert topics.nested(rows.limit(0), 3, 2).count() == 0


def test_principal_components(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4)) * [5, 1, 3, 0.1] + 7
    odd = [(1000, None), (1001, [float("nan"), 1.0, 2.0, 3.0]), (1002, [1.0, None, 2.0, 3.0]), (1003, [])]
    df = spark.createDataFrame([*((i, [float(a) for a in v]) for i, v in enumerate(x)), *odd], "id int, e array<double>").repartition(5)
    rows = reduction.known(df, "id", "e")
    mean, cov = reduction.covariance(rows)
    assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    mean, lines, values = reduction.components(rows, 2, fraction=1.0)
    want, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(values, want[::-1][:2]) and np.allclose(np.abs(lines), np.abs(vectors[:, ::-1][:, :2].T))
    got = {r["id"]: r["v"] for r in reduction.project(df, "id", "e", mean, lines).collect()}
    assert len(got) == 504 and all(np.allclose(got[i], (x[i] - x.mean(0)) @ lines.T) for i in range(500))
    assert all(got[i] == [0.0, 0.0] for i in range(1000, 1004))
    assert 50 < topics.sample(topics.rows_of(df, "id", "e"), 0.25).count() < 200


def test_gradient(spark):
    texts = [("a b c a", 0), ("b c", 1), ("", 2), ("c c d e", 1), (None, 0)]
    rows = spark.createDataFrame(texts, "t string, y int").select("y", classifier.features(F.col("t"), 32).alias("x")).repartition(3)
    x = np.zeros((5, 32))
    kept = rows.collect()
    for i, r in enumerate(kept):
        for b in r["x"]:
            x[i, b] += 1
    rng = np.random.default_rng(1)
    rarity, share = rng.uniform(0.5, 2, 32), np.array([1.0, 0.5, 2.0])
    x = np.sqrt(x) * rarity
    x /= np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-12)
    w = rng.normal(size=(3, 33))
    z = x @ w[:, :-1].T + w[:, -1]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.eye(3)[[r["y"] for r in kept]]
    own = (y @ share)[:, None]
    want = np.concatenate([((p - y) * own).T @ x, ((p - y) * own).sum(0)[:, None]], axis=1) / own.sum()
    got, loss = classifier.gradient(rows, w, rarity, share)
    assert np.allclose(got, want) and loss == pytest.approx((-np.log((p * y).sum(1)) * own[:, 0]).sum() / own.sum())


def test_classifier_learns_words_and_their_order(spark):
    rows = [(i, ["i like it very much", "i do not like it", "it is a thing"][i % 3] + f" said number{i}", ["favor", "against", "neutral"][i % 3] if i < 150 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string, stance string")
    model = classifier.fit(df, "text", "stance")
    got = {r["id"]: r["predicted"] for r in model.predict(df, "id", "text").collect()}
    assert all(got[i] == ["favor", "against", "neutral"][i % 3] for i in range(300))
    assert classifier.fit(df.where("stance IS NULL"), "text", "stance") is None


def test_stances_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    said = learned.stance_classifier(spark, sf_dir).join(learned.stance_labels(spark, sf_dir).where("held_out"), "doc_id").groupBy("stance").agg(F.avg((F.col("stance") == F.col("predicted")).cast("double")).alias("recall")).collect()
    recall = {r["stance"]: r["recall"] for r in said}
    assert sum(recall.values()) / 3 > 0.6, recall


def test_steps_read_packed_rows(spark):
    """Blocks hold what a step needs, row by row, so no step makes it from buckets again."""
    rows = spark.createDataFrame([(i % 3, sorted(int(x) for x in np.random.default_rng(i).integers(0, 50, i % 40))) for i in range(700)], "y int, x array<int>").coalesce(1)
    rarity = np.linspace(1, 2, 50)
    blocks = classifier.packed(rows, rarity).collect()
    assert [len(b["y"]) // 4 for b in blocks] == [512, 188]
    norm = np.bincount(np.frombuffer(blocks[0]["row"], np.int16), np.frombuffer(blocks[0]["weight"]) ** 2, 512)
    assert np.allclose(norm, [i % 40 > 0 for i in range(512)])
