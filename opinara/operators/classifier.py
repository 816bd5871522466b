"""A trained text classifier: multinomial logistic regression on hashed words and word pairs.

Texts become hashed words in the JVM; each step of the fit sums gradients in tasks, and a matrix of classes by buckets, of
fixed size, comes to the driver. Every labelled row takes part in every step, and each class has the same weight. Words
weigh the square root of their count times the logarithm of how rare their bucket is among labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.operators.graph import settled
from opinara.operators.vector_windows import vector_sum

BUCKETS = 1 << 14


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and pairs of words of a text, sorted, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_']+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_sort(F.transform(F.concat(words, pairs), lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")))


def _sparse(column: pa.ListArray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of sorted buckets, of unit length in a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    if not len(flat):
        return row, flat.astype(int), np.zeros(0)
    start = np.flatnonzero(np.concatenate([[True], (np.diff(flat) != 0) | (np.diff(row) != 0)]))
    weight = np.sqrt(np.diff(np.concatenate([start, [len(flat)]])))
    row, flat = row[start], flat[start]
    weight = weight * rarity[flat]
    norm = np.sqrt(np.bincount(row, weight * weight, len(column)))
    return row, flat, weight / np.maximum(norm[row], 1e-12)


def _scores(column: pa.ListArray, w: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, a row each; the last weight of a class is its bias."""
    return _probabilities(len(column), *_sparse(column, rarity), w)


def _probabilities(n: int, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.stack([np.bincount(row, weight * line[bucket], n) for line in w[:, :-1]], axis=1) + w[:, -1]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def packed(rows: DataFrame, rarity: np.ndarray) -> DataFrame:
    """Rows (y, x) as blocks, a batch each: classes, rows, buckets and weights as bytes, so that steps need not make them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                row, bucket, weight = _sparse(part.column(1), rarity)
                cells = (part.column(0).to_numpy(zero_copy_only=False).astype(np.int32), row.astype(np.int16), bucket.astype(np.int32), weight)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["y", "row", "bucket", "weight"])

    return rows.select("y", "x").mapInArrow(run, "y binary, row binary, bucket binary, weight binary")


class Classifier:
    def __init__(self, classes: list[str], weights: np.ndarray, rarity: np.ndarray) -> None:
        self.classes, self.weights, self.rarity = classes, weights, rarity

    def predict(self, df: DataFrame, id_col: str, text: str) -> DataFrame:
        """id, predicted and its probability; ties go to the first class."""
        rows = df.select(F.col(id_col).alias("id"), features(F.col(text), len(self.rarity)).alias("x"))
        w, rarity, classes = self.weights, self.rarity, np.array(self.classes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = _scores(b.column(1), w, rarity)
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes[best].tolist(), pa.string()), pa.array(p[np.arange(len(p)), best])], ["id", "predicted", "probability"])

        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, predicted string, probability double")


def gradient(rows: DataFrame, w: np.ndarray, rarity: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean gradient and loss over rows (y, x), each weighted by the share of its class."""
    return _slope(packed(rows, rarity), w, share)


def _slope(blocks: DataFrame, w: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """gradient() of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(w.shape), 0.0, 0.0
        for b in batches:
            for cells in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                y, row, bucket, weight = (np.frombuffer(c, t) for c, t in zip(cells, (np.int32, np.int16, np.int32, np.float64), strict=True))
                p = _probabilities(len(y), row, bucket, weight, w)
                own = share[y]
                loss -= float((own * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
                p[np.arange(len(y)), y] -= 1
                p *= own[:, None]
                for c in range(len(w)):
                    total[c, :-1] += np.bincount(bucket, weight * p[row, c], w.shape[1] - 1)
                    total[c, -1] += p[:, c].sum()
                n += own.sum()
        if n:
            lines = np.concatenate([total, np.full((len(w), 1), loss), np.full((len(w), 1), n)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * lines.shape[1], pa.int32()), pa.array(lines.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), flat], ["c", "line"])

    parts = blocks.mapInArrow(run, "c int, line array<double>")
    lines = parts.groupBy("c").agg(vector_sum("line").alias("line")).orderBy("c").collect()  # a line a class
    whole = np.array([r["line"] for r in lines])
    return whole[:, :-2] / whole[0, -1], float(whole[0, -2] / whole[0, -1])


def fit(df: DataFrame, text: str, label: str, rounds: int = 60, ridge: float = 1e-5, step: float = 4.0, buckets: int = BUCKETS, tolerance: float = 1e-5) -> Classifier | None:
    """Accelerated gradient steps until no weight's slope exceeds the tolerance; rows without a label are left out. None
    if there is no label."""
    known = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("string")).count().orderBy(label).collect()}  # a row a class
    classes = list(counts)
    if not classes:
        return None
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    rows = settled(known.select(place.cast("int").alias("y"), features(F.col(text), buckets).alias("x")))
    n = sum(counts.values())
    rarity = np.full(buckets, np.log(n + 1.0))
    for r in rows.select(F.explode(F.array_distinct("x")).alias("b")).groupBy("b").count().collect():  # a row a bucket
        rarity[r["b"]] = np.log((n + 1.0) / r["count"])
    share = n / (len(classes) * np.array([counts[c] for c in classes], float))
    w = ahead = np.zeros((len(classes), buckets + 1))
    blocks = packed(rows, rarity).persist(StorageLevel.MEMORY_AND_DISK)
    for i in range(rounds):
        slope, _ = _slope(blocks, ahead, share)
        slope = slope + ridge * ahead
        moved = ahead - step * slope
        w, ahead = moved, moved + i / (i + 3) * (moved - w)
        if np.abs(slope).max() < tolerance:
            break
    blocks.unpersist()
    return Classifier(classes, w, rarity)
