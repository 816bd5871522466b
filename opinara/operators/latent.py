"""A user's latent opinion of a target, seen through the confusion of classifiers.

What is fitted are counts: a row a user and target with how often each classifier gave each prediction. A hidden
opinion is one of three classes, drawn from shares of their own (`categorical`), or a number rounded to -1, 0 or 1 that
follows a Normal or, stretched over -1 to 1, a Beta distribution (`curve`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import beta_moments

#: Least and greatest parameters: mean and log of the deviation; logs of alpha and beta. Priors lie around the last.
NORMAL = (-1.5, math.log(0.05)), (1.5, math.log(3.0)), (0.0, math.log(0.5))
BETA = (math.log(0.2),) * 2, (math.log(50.0),) * 2, (0.0, 0.0)


def emissions(profiles: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(classifier, prediction) pairs, and the probability of each given the opinions -1, 0 and 1."""
    rows = profiles.collect()  # nine rows a classifier
    seen = sorted({(r["classifier_id"], r["predicted"]) for r in rows})
    emit = np.zeros((3, len(seen)))
    for r in rows:
        emit[r["actual"] + 1, seen.index((r["classifier_id"], r["predicted"]))] = r["prob"]
    return seen, emit


def counts(opinions: DataFrame, seen: list[tuple[int, int]]) -> DataFrame:
    """user_id, stance and a column for each (classifier, prediction). Others are not counted."""
    return opinions.groupBy("user_id", "stance").agg(*(F.count_if((F.col("classifier_id") == c) & (F.col("predicted") == p)).alias(f"n{i}") for i, (c, p) in enumerate(seen)))


def categorical(opinions: DataFrame, profiles: DataFrame, steps: int = 25, pseudo: float = 0.5) -> DataFrame:
    """Shares of the three opinions after so many steps of EM from equal shares, with pseudo-counts (0 gives the most
    likely shares), and their mean and variance. Users without an observation have none."""
    seen, emit = emissions(profiles)
    n = [F.col(f"n{i}") for i in range(len(seen))]
    total = sum(n, F.lit(3 * pseudo))

    def step(q, _):
        ratio = [F.coalesce(F.try_divide(n[c], sum((q[f"q{a}"] * float(emit[a, c]) for a in range(3)), F.lit(0.0))), F.lit(0.0)) for c in range(len(seen))]
        return F.struct(*(((pseudo + q[f"q{a}"] * sum((ratio[c] * float(emit[a, c]) for c in range(len(seen))), F.lit(0.0))) / total).alias(f"q{a}") for a in range(3)))

    even = F.struct(*(F.lit(1 / 3).alias(f"q{a}") for a in range(3)))
    some = counts(opinions, seen).where(sum(n, F.lit(0)) > 0)
    q = some.select("user_id", "stance", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), even, step).alias("q")).select("user_id", "stance", "q.*")
    mean = F.col("q2") - F.col("q0")
    tidy = lambda c: F.round(c, 5) + 0.0
    return q.select("user_id", "stance", tidy(F.col("q0")).alias("against"), tidy(F.col("q1")).alias("neutral"), tidy(F.col("q2")).alias("favor"), tidy(mean).alias("mean"), tidy(F.col("q0") + F.col("q2") - mean * mean).alias("variance"))


_erf = np.vectorize(math.erf, otypes=[float])


def normal_shares(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the three opinions and their derivatives by mean and log of the deviation."""
    mean, sd = theta[:, 0], np.exp(theta[:, 1])
    z = (np.array([-0.5, 0.5]) - mean[:, None]) / sd[:, None]
    below, density = 0.5 * (1 + _erf(z / math.sqrt(2))), np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    by = np.stack([-density / sd[:, None], -density * z], 2)
    none = np.zeros((len(theta), 1, 2))
    return np.diff(below, axis=1, prepend=0, append=1), np.diff(np.concatenate([none, by, none], 1), axis=1)


def _nodes() -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre places and weights of an angle whose squared sine is the opinion in 0 to 1, for each third."""
    x, w = np.polynomial.legendre.leggauss(24)
    cuts = np.arcsin(np.sqrt([0, 0.25, 0.75, 1]))
    lo, hi = cuts[:-1, None], cuts[1:, None]
    return (lo + (hi - lo) * (x + 1) / 2), (hi - lo) / 2 * w


ANGLES, WEIGHTS = _nodes()


def beta_shares(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the three opinions and their derivatives by the logs of alpha and beta."""
    a, b = np.exp(theta[:, 0])[:, None, None], np.exp(theta[:, 1])[:, None, None]
    up, down = 2 * np.log(np.sin(ANGLES)), 2 * np.log(np.cos(ANGLES))
    logs = (a - 0.5) * up + (b - 0.5) * down
    w = np.exp(logs - logs.max((1, 2), keepdims=True)) * WEIGHTS
    w /= w.sum((1, 2), keepdims=True)
    q = w.sum(2)
    by = [(w * g).sum(2) - q * (w * g).sum((1, 2))[:, None] for g in (up, down)]
    return q, np.stack([by[0] * a[:, :, 0], by[1] * b[:, :, 0]], 2)


def ascend(n: np.ndarray, emit: np.ndarray, shares: Callable, box: tuple, prior: float, rounds: int = 40) -> np.ndarray:
    """The parameters of greatest likelihood times prior for each row of counts, by damped Fisher scoring from the centre
    and from four places around it, as few observations can have several peaks."""
    lo, hi, centre = (np.array(x) for x in box)
    around = [centre, *(np.array([x, y]) for x in ((lo[0] + centre[0]) / 2, (hi[0] + centre[0]) / 2) for y in ((lo[1] + centre[1]) / 2, (hi[1] + centre[1]) / 2))]
    found = [_climb(n, emit, shares, (lo, hi, centre), prior, at, rounds) for at in around]
    best = np.argmax([v for _, v in found], axis=0)
    return np.stack([t for t, _ in found])[best, np.arange(len(n))]


def _climb(n: np.ndarray, emit: np.ndarray, shares: Callable, box: tuple, prior: float, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an ascent from one place ends, and the value there."""
    lo, hi, centre = box
    theta = np.tile(start, (len(n), 1))

    def value(theta: np.ndarray) -> np.ndarray:
        return (n * np.log(np.maximum(shares(theta)[0] @ emit, 1e-300))).sum(1) - prior / 2 * ((theta - centre) ** 2).sum(1)

    damp, best = np.full(len(n), 1e-3), value(theta)
    for _ in range(rounds):
        q, by = shares(theta)
        p = np.maximum(q @ emit, 1e-300)
        score = np.einsum("sa,sak->sk", (n / p) @ emit.T, by) - prior * (theta - centre)
        seen = np.einsum("ac,sak->sck", emit, by)
        held = ((theta <= lo) & (score < 0)) | ((theta >= hi) & (score > 0))  # at a bound and drawn beyond it
        score, seen = np.where(held, 0, score), np.where(held[:, None, :], 0, seen)
        info = np.einsum("sc,sck,scl->skl", n / p**2, seen, seen) + (prior + damp)[:, None, None] * np.eye(2)
        trial = np.clip(theta + np.linalg.solve(info, score[:, :, None])[:, :, 0], lo, hi)
        there = value(trial)
        better = there >= best
        theta, best = np.where(better[:, None], trial, theta), np.where(better, there, best)
        damp = np.clip(np.where(better, damp / 4, damp * 8), 1e-9, 1e9)
    return theta, best


def curve(opinions: DataFrame, profiles: DataFrame, family: str = "normal", prior: float = 1.0) -> DataFrame:
    """Parameters a and b of each user's Normal (mean, deviation) or Beta (alpha, beta) distribution for each target, with
    the mean and deviation of the opinion in -1 to 1. `prior` is the precision of a Normal prior of the parameters; 0 gives
    the most likely ones within bounds. Users without an observation have none."""
    box, shares = {"normal": (NORMAL, normal_shares), "beta": (BETA, beta_shares)}[family]
    seen, emit = emissions(profiles)
    columns = [f"n{i}" for i in range(len(seen))]
    some = counts(opinions, seen).where(sum((F.col(c) for c in columns), F.lit(0)) > 0)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            theta = ascend(f[columns].to_numpy(float), emit, shares, box, prior)
            yield f[["user_id", "stance"]].assign(a=theta[:, 0] if family == "normal" else np.exp(theta[:, 0]), b=np.exp(theta[:, 1]))

    keys = ", ".join(f"{c} {opinions.schema[c].dataType.simpleString()}" for c in ("user_id", "stance"))
    out = some.mapInPandas(fit, f"{keys}, a double, b double")
    mean, std = (F.col("a"), F.col("b")) if family == "normal" else beta_moments(F.col("a"), F.col("b"))
    if family == "beta":
        mean, std = 2 * mean - 1, 2 * std
    return out.select("user_id", "stance", *(F.round(c, 4).alias(x) for c, x in ((F.col("a"), "a"), (F.col("b"), "b"), (mean, "mean"), (std, "std"))))
