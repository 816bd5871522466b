"""Scalar formulas over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(other_user: Column, user_prev: Column) -> Column:
    return 1 / (1 + F.exp(other_user - user_prev))


def away(other_user: Column, prev_other: Column, user_prev: Column) -> Column:
    """Written as 1 / (1 + exp(-L)), which does not overflow."""
    level = F.when(prev_other == 0, other_user).otherwise(F.try_divide(other_user + user_prev, prev_other) - 1)
    return 1 / (1 + F.exp(-F.least(level, F.lit(100.0))))


def bounded_confidence(distance: Column, power: float, half: float = 0.3) -> Column:
    return F.pow(distance, F.lit(-power)) / (F.pow(distance, F.lit(-power)) + half**-power)


def belief(mean: Column) -> Column:
    """A mean opinion in -1 to 1 as a belief in 0 to 1; no opinion counts as 0 before."""
    return 0.5 * (F.coalesce(mean, F.lit(0.0)) + 1)


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    return F.when(p + r > 0, (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0)


def half_life(age: Column, h: float) -> Column:
    return F.pow(F.lit(2.0), -age / h)


def beta_moments(a: Column, b: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of a Beta distribution."""
    return a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def softmax_expectation(logits: Column) -> Column:
    """Sum of softmax times class, classes counted from 0, minus 1."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / total - 1


def text_quality(user: str, prev: str, viewed: str, least: int = 10) -> Column:
    """False if all three texts are short, or the user's is the one before it. A missing text is short."""
    short = lambda c: F.char_length(F.coalesce(c, F.lit(""))) < least
    return ~((short(user) & short(prev) & short(viewed)) | F.coalesce(F.col(user) == F.col(prev), F.lit(False)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
