"""Correlations, regressions, densities and bootstrap intervals over users' opinions."""

from __future__ import annotations

import math
from statistics import NormalDist
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stance_pairs(snapshots: DataFrame) -> DataFrame:
    """Each user's means and variances on every two targets of a snapshot, targets in order."""
    side = lambda n: snapshots.select("snapshot", "user_id", F.col("stance").alias(f"stance_{n}"), F.col("mean").alias(n), F.col("variance").alias(f"v{n}"))
    return side("x").join(side("y"), ["snapshot", "user_id"]).where("stance_x < stance_y")


def regression(pairs: DataFrame, *keys: str) -> DataFrame:
    """Weighted least squares with weight 1 / max((vx + vy) / 2, 0.01), from sums."""
    w = 1 / F.greatest((F.col("vx") + F.col("vy")) / 2, F.lit(0.01))
    x, y = F.col("x"), F.col("y")
    s = pairs.withColumn("w", w).groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in {"sw": F.col("w"), "sx": F.col("w") * x, "sy": F.col("w") * y, "sxx": F.col("w") * x * x, "sxy": F.col("w") * x * y, "syy": F.col("w") * y * y}.items()))
    cov, vx, vy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    slope = F.try_divide(cov, vx)
    return s.select(*keys, "n", F.round(slope, 6).alias("slope"), F.round((F.col("sy") - slope * F.col("sx")) / F.col("sw"), 6).alias("intercept"), F.round(F.try_divide(cov * cov, vx * vy), 6).alias("r2"))


def correlations(pairs: DataFrame, *keys: str) -> DataFrame:
    """Plain Pearson, clipped, and Pearson with weight exp(-mean variance)."""
    w = F.exp(-(F.col("vx") + F.col("vy")) / 2)
    x, y = F.col("x"), F.col("y")
    sums = {f"{p}{k}": e for p, ww in (("u", F.lit(1.0)), ("w", F.col("w"))) for k, e in {"w": ww, "x": ww * x, "y": ww * y, "xx": ww * x * x, "xy": ww * x * y, "yy": ww * y * y}.items()}
    s = pairs.withColumn("w", w).groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(e).alias(f"s_{k}") for k, e in sums.items()))

    def r(p: str) -> Column:
        c = lambda k: F.col(f"s_{p}{k}")
        cov, vx, vy = c("xy") - c("x") * c("y") / c("w"), c("xx") - c("x") * c("x") / c("w"), c("yy") - c("y") * c("y") / c("w")
        return F.greatest(F.least(F.try_divide(cov, F.sqrt(vx * vy)), F.lit(1.0)), F.lit(-1.0))

    return s.select(*keys, "n", F.round(r("u"), 6).alias("pearson"), F.round(r("w"), 6).alias("weighted_pearson"))


def t_statistic(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([incomplete_beta(d / 2, 0.5, d / (d + v * v)) if v == v and d > 0 else math.nan for v, d in zip(t, dof, strict=True)])

    return p(t, dof.cast("double"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-30) if 1 + num * d > 0 else 1 / min(1 + num * d, -1e-30)
        c = 1 + num / c
        out *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def gaussian_density(snapshots: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Mixture of each user's kernel on a grid from -1 to 1, one unit of mass a user; a user without variance is a point."""
    step = 2.0 / (bins - 1)
    grid = F.sequence(F.lit(0), F.lit(bins - 1))
    raw = snapshots.where("mean IS NOT NULL AND variance IS NOT NULL").withColumn("g", F.transform(grid, lambda i: F.when(F.col("variance") > 0, F.exp(-F.pow(i * step - 1 - F.col("mean"), F.lit(2.0)) / (2 * F.greatest(F.col("variance"), F.lit(1e-12))))).otherwise(F.when(F.floor((F.col("mean") + 1) / step + 0.5) == i, 1.0).otherwise(0.0))))
    mass = F.aggregate("g", F.lit(0.0), lambda a, v: a + v)
    rows = raw.withColumn("mass", mass).where("mass > 0").select(*keys, "mass", F.posexplode("g").alias("cell", "v"))
    sums = rows.groupBy(*keys, "cell").agg(F.sum(F.col("v") / F.col("mass")).alias("d"), F.count("*").alias("users"))
    return sums.select(*keys, "cell", F.round(F.col("cell") * step - 1, 6).alias("at"), F.round(F.col("d") / F.col("users"), 6).alias("density"))


def gaussian_density_2d(pairs: DataFrame, bins: int, *keys: str) -> DataFrame:
    """The same on a square grid with independent axes: the kernel of a cell is the product of two one-dimensional ones."""
    step = 2.0 / (bins - 1)

    def kernel(m: str, v: str) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.when(F.col(v) > 0, F.exp(-F.pow(i * step - 1 - F.col(m), F.lit(2.0)) / (2 * F.greatest(F.col(v), F.lit(1e-12))))).otherwise(F.when(F.floor((F.col(m) + 1) / step + 0.5) == i, 1.0).otherwise(0.0)))
        return g

    rows = pairs.withColumn("gx", kernel("x", "vx")).withColumn("gy", kernel("y", "vy"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("mass", total("gx") * total("gy")).where("mass > 0")
    cells = rows.select(*keys, "gy", "mass", F.posexplode("gx").alias("cx", "px")).select(*keys, "mass", "cx", "px", F.posexplode("gy").alias("cy", "py"))
    return cells.groupBy(*keys, "cx", "cy").agg(F.round(F.sum(F.col("px") * F.col("py") / F.col("mass")) / F.count("*"), 6).alias("density"))


def density_mean(density: DataFrame, *keys: str) -> DataFrame:
    return density.groupBy(*keys).agg(F.round(F.sum(F.col("at") * F.col("density")) / F.sum("density"), 6).alias("density_mean"))


def categorical_joint(opinions: DataFrame) -> DataFrame:
    """Mean over users of the outer products of their class shares on every two targets."""
    n = opinions.groupBy("user_id", "stance", "predicted").agg(F.count("*").alias("c"))
    total = n.groupBy("user_id", "stance").agg(F.sum("c").alias("t"))
    p = n.join(total, ["user_id", "stance"]).select("user_id", "stance", "predicted", (F.col("c") / F.col("t")).alias("p"))
    side = lambda k: p.select("user_id", F.col("stance").alias(f"stance_{k}"), F.col("predicted").alias(f"class_{k}"), F.col("p").alias(f"p_{k}"))
    both = side("x").join(side("y"), "user_id").where("stance_x < stance_y")
    one = total.select("user_id", "stance")
    users = one.select("user_id", F.col("stance").alias("stance_x")).join(one.select("user_id", F.col("stance").alias("stance_y")), "user_id").where("stance_x < stance_y").groupBy("stance_x", "stance_y").agg(F.count("*").alias("users"))
    sums = both.groupBy("stance_x", "stance_y", "class_x", "class_y").agg(F.sum(F.col("p_x") * F.col("p_y")).alias("s"))
    return sums.join(F.broadcast(users), ["stance_x", "stance_y"]).select("stance_x", "stance_y", "class_x", "class_y", F.round(F.col("s") / F.col("users"), 6).alias("share"))


def beta_density(opinions: DataFrame, points: int = 100) -> DataFrame:
    """Mean over users of Beta(1 + favor, 1 + against) densities on a grid of (0, 1), by target."""
    counts = opinions.groupBy("user_id", "stance").agg((1 + F.count_if(F.col("predicted") == 1)).alias("a"), (1 + F.count_if(F.col("predicted") == -1)).alias("b"))
    shapes = counts.groupBy("stance", "a", "b").agg(F.count("*").alias("users"))  # users with the same counts share a curve

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = (np.arange(points) + 0.5) / points
        for f in frames:
            out = []
            for stance, a, b, n in f.itertuples(index=False):
                y = np.exp((a - 1) * np.log(x) + (b - 1) * np.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
                out.append(pd.DataFrame({"stance": stance, "cell": np.arange(points), "y": y * n, "users": n}))
            yield pd.concat(out) if out else pd.DataFrame({"stance": [], "cell": [], "y": [], "users": []})

    rows = shapes.select("stance", "a", "b", "users").mapInPandas(run, "stance string, cell int, y double, users long")
    return rows.groupBy("stance", "cell").agg(F.round(F.sum("y") / F.sum("users"), 6).alias("density"))


def bootstrap(pairs: DataFrame, replicates: int, *keys: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of Pearson's r. A user's weight in a replicate is a Poisson(1) number of user and replicate, so
    replicates are sums and need no second pass."""
    rows = pairs.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", F.expr(poisson("user_id", "cast(r AS bigint)")))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    s = rows.groupBy(*keys, "r").agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy"))
    cov, vx, vy = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    rs = s.where("sw > 0").withColumn("pearson", F.try_divide(cov, F.sqrt(vx * vy)))
    tail = (1 - level) / 2
    return rs.groupBy(*keys).agg(F.round(F.percentile("pearson", F.lit(tail)), 6).alias("lo"), F.round(F.percentile("pearson", F.lit(1 - tail)), 6).alias("hi"))


def pearson_xy(pairs: DataFrame, *keys: str) -> DataFrame:
    """r of x and y with weights of their own, exp(-variance); the covariance is weighted by their product. t takes the
    summed products less two (null unless positive), p_value the rows less two as degrees of freedom."""
    w = pairs.withColumn("wx", F.exp(-F.col("vx"))).withColumn("wy", F.exp(-F.col("vy")))
    means = w.groupBy(*keys).agg((F.sum(F.col("wx") * F.col("x")) / F.sum("wx")).alias("mx"), (F.sum(F.col("wy") * F.col("y")) / F.sum("wy")).alias("my"))
    dx, dy, both = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("wx") * F.col("wy")
    sums = w.join(means, list(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(both).alias("ww"), (F.sum(both * dx * dy) / F.sum(both)).alias("cov"), (F.sum(F.col("wx") * dx * dx) / F.sum("wx")).alias("a"), (F.sum(F.col("wy") * dy * dy) / F.sum("wy")).alias("b"))
    r = sums.select(*keys, "n", "ww", F.try_divide(F.col("cov"), F.sqrt(F.col("a") * F.col("b"))).alias("r"))
    r = r.withColumn("t", F.when(F.col("ww") > 2, t_statistic(F.col("r"), F.col("ww"))))
    return r.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 2))


def regression_test(pairs: DataFrame, *keys: str) -> DataFrame:
    """`regression` with t and two-sided p_value of the slope against 0; both null where the fit leaves no residual."""
    fit = regression(pairs, *keys)
    t = F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    fit = fit.withColumn("t", F.when((F.col("n") > 2) & (F.col("r2") < 1), t))
    return fit.withColumn("p_value", t_p_value(F.col("t"), F.col("n") - 2))


def mean_test(pairs: DataFrame, *keys: str) -> DataFrame:
    """Means of x and y with weights exp(-mean variance), scaled to a mean of 1, and their t against 0 at n - 1 degrees of freedom."""
    w = pairs.withColumn("w", F.exp(-(F.col("vx") + F.col("vy")) / 2))
    sums = w.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), *(e.alias(f"{k}{c}") for c in ("x", "y") for k, e in (("s", F.sum(F.col("w") * F.col(c))), ("q", F.sum(F.col("w") * F.col(c) * F.col(c))))))
    for c in ("x", "y"):
        mean = F.col(f"s{c}") / F.col("sw")
        spread = F.sqrt(F.greatest(F.col(f"q{c}") / F.col("sw") - mean * mean, F.lit(0.0)))
        sums = sums.withColumn(f"mean_{c}", mean).withColumn(f"t_{c}", F.when((F.col("n") > 1) & (spread > 1e-9), mean / spread * F.sqrt(F.col("n") - 1)))
        sums = sums.withColumn(f"p_{c}", t_p_value(F.col(f"t_{c}"), F.col("n") - 1))
    return sums.select(*keys, "n", *(f"{k}_{c}" for c in ("x", "y") for k in ("mean", "t", "p")))


def poisson(user: str, replicate: str) -> str:
    """SQL of a Poisson(1) weight that follows from a user's number and a replicate's; the same in any engine."""
    u, p = f"(({user} % 1000003 + 1000003) % 1000003)", 1_000_003
    first = f"(({u} * 7919 + {replicate} * 104729 + 12345) % {p})"
    second = f"(({first} * {first} + 31 * {first} + {replicate} * 7907) % {p})"
    share = f"(({second} * {second} + 17 * {second} + {u}) % {p})"
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    return "CASE " + " ".join(f"WHEN {share} < {math.floor(c * p)} THEN {k}" for k, c in enumerate(cuts)) + f" ELSE {len(cuts)} END"


# Coefficients of approximations to the normal distribution and its quantiles.
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_T, _NORM = 0.2316419, 0.3989422804014327
_C, _D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)


def normal(x: str) -> str:
    """SQL of the normal distribution function, to 1e-7."""
    t = f"(1 / (1 + {_T}e0 * abs({x})))"
    sum_ = f"{_B[4]}e0"
    for c in reversed(_B[:4]):
        sum_ = f"({c}e0 + {t} * {sum_})"
    tail = f"({_NORM}e0 * exp(-{x} * {x} / 2) * {t} * {sum_})"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def normal_quantile(p: str) -> str:
    """SQL of the normal quantile, to 5e-4; `refined` brings it to 1e-6."""
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    x = f"({t} - ({_C[0]}e0 + {t} * ({_C[1]}e0 + {t} * {_C[2]}e0)) / (1 + {t} * ({_D[0]}e0 + {t} * ({_D[1]}e0 + {t} * {_D[2]}e0))))"
    return f"(CASE WHEN {p} < 0.5 THEN -{x} ELSE {x} END)"


def refined(x: str, p: str) -> str:
    """SQL of a quantile after a Newton step."""
    return f"({x} - ({normal(x)} - {p}) / ({_NORM}e0 * exp(-{x} * {x} / 2)))"


def bca_steps(level: float, replicates: int) -> list[tuple[str, str]]:
    """Columns, one after the other, from estimate, share (of replicates below it), n and the moments s1, s2, s3 of the
    leave-one-out estimates less the estimate, to at_lo and at_hi: where among the sorted replicates the bounds lie."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    steps = [
        ("p0", f"least(greatest(share, {0.5 / replicates}e0), 1 - {0.5 / replicates}e0)"),
        ("x0", normal_quantile("p0")),
        ("z0", refined("x0", "p0")),
        ("q2", "(s2 - s1 * s1 / n)"),
        ("q3", "(s3 - 3 * s1 / n * s2 + 2 * s1 * s1 * s1 / (n * n))"),
        ("acc", "CASE WHEN q2 > 1e-18 THEN -q3 / (6 * q2 * sqrt(q2)) ELSE 0e0 END"),
    ]
    for name, end in (("lo", -z), ("hi", z)):
        steps += [(f"z_{name}", f"z0 + (z0 + {end}e0) / (1 - acc * (z0 + {end}e0))"), (f"at_{name}", f"{normal(f'z_{name}')} * (m - 1)")]
    return steps


def bootstrap_mean(snapshots: DataFrame, replicates: int, *keys: str, level: float = 0.95) -> DataFrame:
    """Mean opinion with weights exp(-variance) and its bias-corrected accelerated interval. Users keep or lose weight in a
    replicate by a Poisson number, so replicates are sums; leave-one-out means come from the sums less a user's part."""
    rows = snapshots.where("mean IS NOT NULL AND variance IS NOT NULL").select(*keys, "user_id", "mean", F.exp(-F.col("variance")).alias("w"))
    whole = rows.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("mean")).alias("sm"), F.count("*").alias("n"))
    without = F.col("sw") - F.col("w")
    off = F.when(without > 1e-12, (F.col("sm") - F.col("w") * F.col("mean")) / without - F.col("sm") / F.col("sw")).otherwise(0.0)
    moments = rows.join(whole, list(keys)).withColumn("off", off).groupBy(*keys).agg((F.first("sm") / F.first("sw")).alias("estimate"), F.first("n").alias("n"), *(F.sum(F.pow("off", F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3)))
    again = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", F.col("w") * F.expr(poisson("user_id", "cast(r AS bigint)")))
    drawn = again.groupBy(*keys, "r").agg(F.try_divide(F.sum(F.col("w") * F.col("mean")), F.sum("w")).alias("v")).where("v IS NOT NULL").join(moments, list(keys))
    w = Window.partitionBy(*keys)  # a row a replicate
    placed = drawn.withColumn("i", F.row_number().over(w.orderBy("v", "r")) - 1).withColumn("next", F.lead("v").over(w.orderBy("v", "r")))
    placed = placed.withColumn("m", F.count("*").over(w)).withColumn("share", F.avg((F.col("v") < F.col("estimate") - 1e-12).cast("double") + (F.abs(F.col("v") - F.col("estimate")) <= 1e-12).cast("double") / 2).over(w))
    for name, value in bca_steps(level, replicates):
        placed = placed.withColumn(name, F.expr(value))
    bound = lambda at: F.max(F.when(F.floor(at) == F.col("i"), F.col("v") + (F.col(at) - F.col("i")) * (F.coalesce("next", "v") - F.col("v"))))
    return placed.groupBy(*keys).agg(F.round(F.first("estimate"), 6).alias("mean"), F.round(bound("at_lo"), 6).alias("lo"), F.round(bound("at_hi"), 6).alias("hi"))


def beta_density_2d(opinions: DataFrame, points: int = 20) -> DataFrame:
    """Mean over users of the outer product of their Beta densities on every two targets, on a grid of (0, 1) squared."""
    counts = opinions.groupBy("user_id", "stance").agg((1 + F.count_if(F.col("predicted") == 1)).alias("a"), (1 + F.count_if(F.col("predicted") == -1)).alias("b"))
    side = lambda k: counts.select("user_id", F.col("stance").alias(f"stance_{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
    pairs = side("x").join(side("y"), "user_id").where("stance_x < stance_y")
    shapes = pairs.groupBy("stance_x", "stance_y", "ax", "bx", "ay", "by").agg(F.count("*").alias("users"))  # users of the same counts share a surface

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = (np.arange(points) + 0.5) / points
        curve = lambda a, b: np.exp((a - 1) * np.log(grid) + (b - 1) * np.log(1 - grid) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        cx, cy = (c.ravel() for c in np.indices((points, points)))
        for f in frames:
            for (x, y), g in f.groupby(["stance_x", "stance_y"]):
                total = sum(n * np.outer(curve(ax, bx), curve(ay, by)) for ax, bx, ay, by, n in g[["ax", "bx", "ay", "by", "users"]].itertuples(index=False))
                yield pd.DataFrame({"stance_x": x, "stance_y": y, "cx": cx, "cy": cy, "mass": total.ravel(), "users": g["users"].sum()})

    rows = shapes.mapInPandas(run, "stance_x string, stance_y string, cx int, cy int, mass double, users long")
    return rows.groupBy("stance_x", "stance_y", "cx", "cy").agg(F.round(F.sum("mass") / F.sum("users"), 6).alias("density"))


def beta_quantile(a: Column, b: Column, q: float) -> Column:
    """Quantile of a Beta distribution, by bisection of its distribution function."""

    @F.pandas_udf("double")
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            lo, hi = 0.0, 1.0
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if incomplete_beta(x, y, mid) < q else (lo, mid)
            out.append((lo + hi) / 2 if x == x and y == y else math.nan)
        return pd.Series(out)

    return find(a.cast("double"), b.cast("double"))
