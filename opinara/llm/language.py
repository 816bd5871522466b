"""Language of whole texts: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies are counted over all learning rows. The weights are fitted on a bounded sample of them, equally many
rows of each language (`LEAST_EACH` at least) with the least hash of their id, so rare languages are learned too, by follow-the-regularised-leader with L1 and L2 penalties, one text at a
time; L1 leaves most n-grams without weight. A part of the sample is held back to calibrate the temperature of the
softmax. Then every row is scored by its whole text.

Null text, or text without a letter: `und` with score 0. A tie goes to the first language by name. Rows with a null
language teach nothing; without any learning row every prediction is `und`. Repeated rows repeat, an empty table gives
an empty one, a long text is one vector, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

BUCKETS = 1 << 14
SAMPLE, LEAST_EACH, HELD_BACK, EPOCHS = 2400, 40, 5, 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.0001
MIN_GRAM, MAX_GRAM = 1, 3

_FOLD = np.arange(256, dtype=np.uint32)  # of ASCII what is no letter counts as a space; Latin-1 in lower case
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0xC0:0xDF] += 32
_FOLD[0xD7] = 0xD7


def grams(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of the n-grams of characters of each row."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    low = code < 256
    code[low] = _FOLD[code[low]]
    # every byte but those that continue a character begins one
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][at]
    n = len(code)
    hashed = []
    for k in range(MIN_GRAM, MAX_GRAM + 1):
        h = np.full(max(0, n - k + 1), k, np.uint32)
        for i in range(k):
            h = (h ^ code[i : n - k + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        hashed.append(h % np.uint32(buckets))
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        own = np.concatenate([h[a : max(a, b - k)] for k, h in enumerate(hashed, MIN_GRAM - 1)]) if b > a else np.zeros(0, np.uint32)
        counts = np.bincount(own, minlength=buckets)
        some = np.flatnonzero(counts)
        yield some, counts[some]


def vector(some: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(counts)) * idf[some]
    return some, x / (np.sqrt(x @ x) or 1.0)


def has_letter(text: str | None) -> bool:
    """A letter in Unicode's sense. Nearly always one of the first characters is."""
    return text is not None and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text[64:])))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int = BUCKETS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (buckets x classes); each text updates the coordinates it has."""
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))

    def weights(some: np.ndarray | slice) -> np.ndarray:
        own = z[some]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[some])) / ALPHA + L2))

    for _ in range(epochs):
        for some, x, y in rows:
            w = weights(some)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            grown = n[some] + g * g
            z[some] += g - (np.sqrt(grown) - np.sqrt(n[some])) / ALPHA * w
            n[some] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(softmax(logits / np.exp(u))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def frequencies(texts: DataFrame, buckets: int) -> tuple[int, np.ndarray]:
    """Rows, and rows that have each bucket, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                for some, _ in grams(*tk.text_buffer(part.column("text")), buckets):
                    df[some] += 1
                    rows += 1
        df[buckets] = rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row a bucket
    df = np.zeros(buckets + 1, np.int64)
    df[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return int(df[buckets]), df[:buckets]


def learn(rows: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> dict | None:
    """rows: doc_id, text, lang of the learning rows. None if there are none."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total, df = frequencies(rows, buckets)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                got = list(grams(*tk.text_buffer(part.column("text")), buckets))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("key"), pa.array([a.astype("<u4").tobytes() for a, _ in got], pa.binary()), pa.array([np.asarray(c, "<u4").tobytes() for _, c in got], pa.binary())], ["lang", "key", "some", "counts"])

    # as many rows of each language, about twice as many by hash first
    counts = dict(rows.groupBy("lang").count().collect())  # one row a language
    each = max(LEAST_EACH, sample // len(counts))
    shares = rows.sparkSession.createDataFrame([(c, min(1.0, 2 * each / n)) for c, n in counts.items()], "lang string, share double")
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(3))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod(key, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    got = chosen.select("lang", "text", key.alias("key")).mapInArrow(run, "lang string, key long, some binary, counts binary").toPandas()
    got = got.sort_values(["key", "lang", "some"]).groupby("lang").head(each)
    names = sorted(got["lang"].unique())
    data = [(*vector(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(c, "<u4"), idf), names.index(y)) for y, a, c in zip(got["lang"], got["some"], got["counts"], strict=True)]
    held = data[::HELD_BACK] if len(data) >= 5 * HELD_BACK else []
    weights = fit_ftrl([r for i, r in enumerate(data) if not held or i % HELD_BACK], len(names), buckets)
    logits = np.array([x @ weights[some] for some, x, _ in held]).reshape(-1, len(names))
    return {"names": names, "idf": idf, "weights": weights, "temperature": temperature(logits, np.array([y for *_, y in held], int))}


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """lang_pred and score of each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in tk.slices(batch, "text"):
                langs, scores = [], []
                for text, (some, counts) in zip(part.column("text").to_pylist(), grams(*tk.text_buffer(part.column("text")), buckets), strict=True):
                    if m is None or not has_letter(text):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    some, x = vector(some, counts, m["idf"])
                    p = softmax(x @ m["weights"][some] / m["temperature"])
                    langs.append(m["names"][int(p.argmax())])
                    scores.append(float(p.max()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder is not 2."""
    docs = tk.documents(spark, sf_dir)
    model = learn(docs.where(tk.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", (tk.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
