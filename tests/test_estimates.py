"""Chains, spline curves and latent opinions against plain versions written apart."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.functions import scores
from opinara.operators import chains, evaluation, latent, models
from opinara.plans import catalogue
from opinara.sources import fixtures

SCHEMA = "user_id long, stance string, ts long, event_id long, classifier_id long, predicted int"


def made(spark, seed=5, users=6):
    """Sequences of 1 to 200 opinions with many equal times."""
    rng = np.random.default_rng(seed)
    rows = [(u, s, int(t // 3), i * 7 % 1000 + t * 1000, int(rng.integers(3)), int(rng.integers(-1, 2))) for u in range(users) for i, s in enumerate(("a", "b")) for t in range(int(rng.choice([1, 2, 9, 50, 200])))]
    return spark.createDataFrame(rows, SCHEMA), rows


def plain_hmm(rows, profiles, rounds, pseudo):
    """Baum-Welch over whole sequences, without logs or chunks but with scaling by step."""
    emit = {(r["classifier_id"], r["predicted"], r["actual"]): r["prob"] for r in profiles.collect()}
    out = {}
    for s in sorted({r[1] for r in rows}):
        seqs = [[x[4:] for x in sorted((r for r in rows if r[0] == u and r[1] == s), key=lambda r: (r[2], r[3]))] for u in {r[0] for r in rows if r[1] == s}]
        start, move = np.full(3, 1 / 3), np.full((3, 3), 0.05) + 0.85 * np.eye(3)
        for _ in range(rounds):
            first, pairs = np.zeros(3), np.zeros((3, 3))
            for seq in seqs:
                e = np.array([[emit[(c, p, a)] for a in (-1, 0, 1)] for c, p in seq])
                f = [start * e[0] / (start * e[0]).sum()]
                for x in e[1:]:
                    v = (f[-1] @ move) * x
                    f.append(v / v.sum())
                b = np.ones(3)
                for t in range(len(e) - 1, 0, -1):
                    m = f[t - 1][:, None] * move * (e[t] * b)[None, :]
                    pairs += m / m.sum()
                    b = move @ (e[t] * b)
                    b /= b.sum()
                first += f[0] * b / (f[0] * b).sum()
            start = (first + pseudo) / (first + pseudo).sum()
            move = (pairs + pseudo) / (pairs + pseudo).sum(1, keepdims=True)
        out.update({(s, i - 1, j - 1): move[i, j] for i in range(3) for j in range(3)})
    return out


@pytest.mark.parametrize(("size", "fan"), [(1000, 1000), (16, 1000), (7, 3)])
def test_chain_in_chunks_is_the_plain_one(spark, size, fan):
    o, rows = made(spark)
    profiles = fixtures.profiles(spark)
    got = {(r["stance"], r["state"], r["next"]): r["prob"] for r in chains.hmm(o.repartition(5), profiles, rounds=3, tolerance=0, size=size, fan=fan).collect()}
    want = plain_hmm(rows, profiles, 3, 1.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_chain_of_nothing(spark):
    o, _ = made(spark)
    profiles = fixtures.profiles(spark)
    assert chains.hmm(o.where("false"), profiles).count() == 0
    unknown = o.withColumn("predicted", F.when(F.col("user_id") > 0, F.col("predicted")))
    assert sorted(chains.hmm(unknown, profiles, rounds=2).collect()) == sorted(chains.hmm(o.where("user_id > 0").unionByName(o.where("false")), profiles, rounds=2).collect())


def test_splines_by_sums_are_the_whole_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(u, "s", i, int(rng.integers(-1, 2)), float(rng.integers(0, 10**6))) for u, n in ((1, 40), (2, 7), (3, 1)) for i in range(n)]
    o = spark.createDataFrame(rows, "user_id long, stance string, event_id long, predicted int, sec double").withColumn("ts", F.timestamp_seconds("sec"))
    got = {(r["user_id"], r["point"]): (r["mean"], r["lo"], r["hi"]) for r in models.splines(o).collect()}
    assert len(got) == 36
    for u in (1, 2, 3):
        x, y = np.array([r[4] for r in rows if r[0] == u]) / 86400, np.array([r[3] for r in rows if r[0] == u], float)
        lo, hi = x.min(), max(x.max(), x.min() + 1e-9)
        hat = lambda v: np.maximum(0, 1 - np.abs((v[:, None] - lo) / (hi - lo) * 5 - np.arange(6)))  # noqa: B023, E731
        b, g = hat(x), hat(np.linspace(lo, hi, 12))
        w = np.linalg.solve(b.T @ b + np.eye(6), b.T @ y)
        half = 1.96 * np.sqrt(((y - b @ w) ** 2).mean() * np.einsum("ij,jk,ik->i", g, np.linalg.inv(b.T @ b + np.eye(6)), g))
        for i in range(12):
            assert np.allclose(got[(u, i)], (g[i] @ w, g[i] @ w - half[i], g[i] @ w + half[i]), atol=2e-5)


def test_derivatives_of_shares():
    rng = np.random.default_rng(0)
    for shares, (lo, hi, _) in ((latent.normal_shares, latent.NORMAL), (latent.beta_shares, latent.BETA)):
        theta = rng.uniform(lo, hi, (50, 2))
        q, by = shares(theta)
        assert np.allclose(q.sum(1), 1) and (q >= 0).all()
        for k in range(2):
            d = np.eye(2)[k] * 1e-5
            assert np.allclose((shares(theta + d)[0] - shares(theta - d)[0]) / 2e-5, by[:, :, k], atol=1e-5)
    flat = latent.beta_shares(np.array([[0.0, 0.0], [math.log(2), 0.0]]))[0]
    assert np.allclose(flat, [[0.25, 0.5, 0.25], [1 / 16, 0.5, 7 / 16]])


@pytest.mark.parametrize("family", ["normal", "beta"])
@pytest.mark.parametrize("prior", [0.0, 1.0])
def test_curves_are_the_best_of_a_grid(spark, family, prior):
    profiles = fixtures.profiles(spark)
    box, shares = {"normal": (latent.NORMAL, latent.normal_shares), "beta": (latent.BETA, latent.beta_shares)}[family]
    seen, emit = latent.emissions(profiles)
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(0, 20, (30, 9)), rng.integers(0, 2, (30, 9)), np.eye(9, dtype=int)])
    theta = latent.ascend(n.astype(float), emit, shares, box, prior)
    grid = np.array(list(itertools.product(*(np.linspace(a, b, 120) for a, b in zip(*box[:2], strict=True)))))
    worth = lambda t: n @ np.log(shares(t)[0] @ emit).T - prior / 2 * ((t - np.array(box[2])) ** 2).sum(1)[None, :]
    mine = np.array([worth(theta)[i, i] for i in range(len(n))])
    assert (mine >= worth(grid).max(1) - 1e-3).all()


def test_curves_find_planted_opinions(spark):
    rng = np.random.default_rng(4)
    rows = []
    for u, mean in enumerate((-0.8, -0.2, 0.3, 0.9)):
        hidden = np.clip(np.rint(rng.normal(mean, 0.5, 3000)), -1, 1).astype(int)
        for i, a in enumerate(hidden):
            c = i % 3
            d = (0.9, 0.8, 0.7)[c]
            rows.append((u, "s", i, i, c, int(rng.choice([-1, 0, 1], p=[d if p == a else (1 - d) / 2 for p in (-1, 0, 1)]))))
    o, profiles = spark.createDataFrame(rows, SCHEMA), fixtures.profiles(spark)
    for r in latent.curve(o, profiles).collect():
        assert abs(r["mean"] - (-0.8, -0.2, 0.3, 0.9)[r["user_id"]]) < 0.08 and abs(r["std"] - 0.5) < 0.1
    shares = {r["user_id"]: r for r in latent.categorical(o, profiles, steps=100, pseudo=0).collect()}
    for r in latent.curve(o, profiles, "beta").collect():
        assert abs(r["mean"] - shares[r["user_id"]]["mean"]) < 0.2 and r["a"] > 0 and r["b"] > 0
    assert latent.curve(o.where("false"), profiles).count() == latent.categorical(o.where("false"), profiles).count() == 0
    assert latent.curve(o.withColumn("predicted", F.lit(None).cast("int")), profiles).count() == 0


def test_gate_listing_and_means(spark):
    runs = spark.createDataFrame([("favor", "m1", 0.5, 0.9), ("favor", "m2", 0.6, 0.7), ("favor", "m3", 0.6, 0.70001), ("against", "m1", 0.2, 0.9)], "class string, run string, precision double, f1 double")
    assert [tuple(r) for r in evaluation.best(runs, "f1", "run", "class", gate="precision").collect()] == [("favor", "m2", 0.6, 0.7)]
    notes = spark.createDataFrame([(1, 1, "favor"), (1, 2, "favor"), (2, 1, "favor"), (2, 2, "against")], "doc_id int, annotator int, label string")
    assert [tuple(r) for r in evaluation.disagreements(notes, 2).collect()] == [(2, "favor", "against")]
    macro = spark.createDataFrame([("r", "t1", 0.5, 1.0, 0.2), ("r", "t2", 0.7, 0.0, 0.4)], "run string, target string, macro_precision double, macro_recall double, macro_f1 double")
    assert [tuple(r) for r in evaluation.target_means(macro, "run").collect()] == [("r", 2, 0.6, 0.5, 0.3)]


def test_text_quality_of_three(spark):
    rows = [("short", "short2", "small", False), ("short", "short2", "long enough text", True), ("short", None, None, False), ("the same long text", "the same long text", "x", False), ("a text of its own", None, None, True)]
    df = spark.createDataFrame(rows, "user string, prev string, viewed string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", scores.text_quality("user", "prev", "viewed")).collect())


def test_queries_are_not_empty(spark, sf_dir):
    for name in ("best_run_gated", "target_mean_scores", "disagreement_listing", "latent_categorical"):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0, name
