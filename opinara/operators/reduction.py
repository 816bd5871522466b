"""Fewer dimensions by principal components (PCA, a linear method), fitted on a sample and applied to all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.topics import sample
from opinara.operators.vector_windows import vector_sum


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of rows (v, no nulls). Tasks multiply their batches; the partial matrices are
    added up line by line in the shuffle, so d lines of d numbers come to the driver, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)  # the first line then holds number and sum
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            lines = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * len(total), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), lines], ["i", "line"])

    parts = rows.select("v").mapInArrow(run, "i int, line array<double>")
    lines = parts.groupBy("i").agg(vector_sum("line").alias("line")).orderBy("i").collect()
    whole = np.array([r["line"] for r in lines]) if lines else np.zeros((1, 1))
    return int(whole[0, 0]), whole[0, 1:], whole[1:, 1:]


def covariance(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (population) covariance."""
    n, s, g = gram(rows)
    mean = s / max(n, 1)
    return mean, g / max(n, 1) - np.outer(mean, mean)


def components(rows: DataFrame, dims: int, fraction: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, directions of most variance (one a line, the largest entry positive) and their variances, of a sample."""
    mean, cov = covariance(sample(rows, fraction))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:dims]
    lines = vectors[:, order].T
    signs = np.sign(lines[np.arange(len(lines)), np.abs(lines).argmax(1)])
    return mean, lines * signs[:, None], values[order]


def project(df: DataFrame, id_col: str, vector: str, mean: np.ndarray, lines: np.ndarray) -> DataFrame:
    """id and its coordinates; NaN and null entries, and null vectors, give zeros."""
    d, dims = len(mean), len(lines)
    clean = F.transform(F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")), lambda x: x)
    rows = df.select(F.col(id_col).alias("id"), clean.alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            whole = np.flatnonzero(np.diff(column.offsets.to_numpy()) == d)
            out = np.zeros((b.num_rows, dims))
            if len(whole) and d:
                x = _matrix(column.take(pa.array(whole)))
                out[whole] = np.nan_to_num((x - mean) @ lines.T)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dims, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["id", "v"])

    return rows.mapInArrow(run, f"id {id_type}, v array<double>")


def known(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v of the rows to fit on: those with entries, none of them null or NaN."""
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
