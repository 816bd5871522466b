"""Models: posterior of a latent opinion, spline curves, flow fields and a predict hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def posterior(opinions: DataFrame, profiles: DataFrame, step: float = 0.05) -> DataFrame:
    """Posterior mean and variance of each user's latent opinion on a grid with a flat prior. Observations enter as counts
    of (classifier, prediction), so the grid meets a few rows a user."""
    counts = opinions.groupBy("user_id", "stance", "classifier_id", "predicted").agg(F.count("*").alias("c"))
    points = round(2 / step) + 1
    grid = profiles.select("classifier_id", "predicted", "actual", "prob", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"))
    theta = F.col("g") * step - 1
    share = F.when(F.col("actual") == 0, 1 - F.abs(theta)).when(F.col("actual") == 1, F.greatest(theta, F.lit(0.0))).otherwise(F.greatest(-theta, F.lit(0.0)))
    table = grid.groupBy("classifier_id", "predicted", "g").agg(F.ln(F.sum(F.col("prob") * share)).alias("ll"))
    logs = counts.join(F.broadcast(table), ["classifier_id", "predicted"]).groupBy("user_id", "stance", "g").agg(F.sum(F.col("c") * F.col("ll")).alias("ll"))
    top = Window.partitionBy("user_id", "stance")
    w = logs.withColumn("w", F.exp(F.col("ll") - F.max("ll").over(top))).withColumn("t", theta)
    mean = F.sum(F.col("w") * F.col("t")) / F.sum("w")
    return w.groupBy("user_id", "stance").agg(F.round(mean, 6).alias("mean"), F.round(F.sum(F.col("w") * F.col("t") * F.col("t")) / F.sum("w") - mean * mean, 6).alias("variance"))


def splines(opinions: DataFrame, knots: int = 6, points: int = 12, ridge: float = 1.0) -> DataFrame:
    """Ridge regression of each user's opinions on a linear B-spline basis of time, with a 95 % band. A row touches the two
    basis functions around it, so sums by (user, target, interval) are all that a fit needs."""
    keys = ["user_id", "stance"]
    rows = opinions.select(*keys, (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000.0).alias("t"), F.col("predicted").cast("double").alias("y")).where("t IS NOT NULL AND y IS NOT NULL")
    spans = rows.groupBy(*keys).agg(F.min("t").alias("lo"), F.greatest(F.max("t"), F.min("t") + 1e-9).alias("hi"))
    u = (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (knots - 1)
    cell = F.least(F.floor(u), F.lit(knots - 2))
    f, y = F.col("f"), F.col("y")
    placed = rows.join(spans, keys).select(*keys, cell.cast("int").alias("cell"), (u - cell).alias("f"), "y")
    sums = {"n": F.lit(1.0), "f": f, "ff": f * f, "y": y, "fy": f * y, "yy": y * y}
    cells = placed.groupBy(*keys, "cell").agg(*(F.sum(c).alias(x) for x, c in sums.items()))
    curves = cells.groupBy(*keys).agg(F.collect_list(F.array(F.col("cell").cast("double"), *sums)).alias("cells"))  # at most knots - 1 a user

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.linspace(0, knots - 1, points)
        g = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(knots)))
        for frame in frames:
            parts = []
            for user, stance, rows in zip(frame["user_id"], frame["stance"], frame["cells"], strict=True):
                inner, outer, n, squares = np.zeros((knots, knots)), np.zeros(knots), 0.0, 0.0
                for cell, one, f, ff, y, fy, yy in sorted(map(tuple, rows)):
                    k = int(cell)
                    inner[k : k + 2, k : k + 2] += [[one - 2 * f + ff, f - ff], [f - ff, ff]]
                    outer[k : k + 2] += [y - fy, fy]
                    n, squares = n + one, squares + yy
                inverse = np.linalg.inv(inner + ridge * np.eye(knots))
                w = inverse @ outer
                noise = max(squares - 2 * w @ outer + w @ inner @ w, 0) / n
                half = 1.96 * np.sqrt(np.maximum(noise * ((g @ inverse) * g).sum(1), 0))
                parts.append(pd.DataFrame({"user_id": user, "stance": stance, "point": range(points), "mean": np.round(g @ w, 6), "lo": np.round(g @ w - half, 6), "hi": np.round(g @ w + half, 6)}))
            if parts:
                yield pd.concat(parts)

    named = ", ".join(f"{c} {opinions.schema[c].dataType.simpleString()}" for c in keys)
    return curves.mapInPandas(fit, f"{named}, point int, mean double, lo double, hi double")


def flow_field(snapshots: DataFrame, x: str, y: str, cells: int = 10) -> DataFrame:
    """Mean move from each cell of two targets' means to the next snapshot."""
    wide = snapshots.groupBy("user_id", "snapshot").agg(F.max(F.when(F.col("stance") == x, F.col("mean"))).alias("x"), F.max(F.when(F.col("stance") == y, F.col("mean"))).alias("y"))
    w = Window.partitionBy("user_id").orderBy("snapshot")
    steps = wide.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y")).where("dx IS NOT NULL AND dy IS NOT NULL")
    cell = lambda c: F.least(F.floor(F.round((F.col(c) + 1) / 2 * cells, 9)), F.lit(cells - 1))
    return steps.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"), F.round(F.avg("dx"), 6).alias("dx"), F.round(F.avg("dy"), 6).alias("dy"))


def predict(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str, out: str = "predicted") -> DataFrame:
    """A column from a batch prediction function, whatever model is behind it; rows of like length come together."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: fn(f[text])})

    return df.sortWithinPartitions(F.char_length(text)).mapInPandas(run, schema)


def lexicon(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: more endings of one kind than of the other."""
    lower = texts.fillna("").str.lower()
    for_, against = lower.str.count(r"\b\w*ing\b"), lower.str.count(r"\b\w*ed\b")
    return pd.Series(np.where(for_ > against, "favor", np.where(against > for_, "against", "neutral")), index=texts.index)
