"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` words. Each passage is encoded as shares of kinds of characters, statistics of
its words and a signed random projection of its words. Gated attention, sigmoid(U h) * tanh(V h) weighted by w, gives
each passage of a text its share; the label's probability is logistic in the weighted mean of the passages. Only labels
of whole texts are learned from: a bounded sample of `EACH` rows of each class, weighted by the classes' shares among
all learning rows, so that scores stay probabilities.

A text that is learned from gives at most `BAG` passages, at even distances; every passage of every text is scored.
An empty or null text is one passage of zeros. An empty table gives an empty one. A score on the limit is accepted. Without learning rows of both classes every score is the share of label
1, or 0.5. Repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

PASSAGE, EACH, BAG, PROJECTED, HIDDEN, STEPS = 64, 1500, 256, 24, 24, 250
ACCEPT = 0.3

_KIND = np.full(256, 9, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"'\"()-", b"#*$%&|<>@=_/\\~^{}[]+`")):
    _KIND[list(_chars)] = _i
_KIND[128:] = 10
KINDS = 11
SIZE = KINDS + 6 + PROJECTED


def encode(data: np.ndarray, at: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the row of each; every row has a passage."""
    n = len(at) - 1
    h, rows, starts, ends = tk.words(data, at)
    first = tk.per_row(rows, n)
    counts = np.diff(first)
    bags = np.maximum(1, -(-counts // passage))
    base = np.concatenate([[0], np.cumsum(bags)])
    of_row = np.repeat(np.arange(n), bags)
    x = np.zeros((int(base[-1]), SIZE), np.float32)
    if not len(h):
        return x, of_row
    # the last passage of a row may be short; its words are spread so that a row's passages have nearly equal size
    place = np.arange(len(h)) - first[rows]
    own = base[rows] + place * bags[rows] // counts[rows]
    fresh = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    filled = own[fresh]
    # characters from a passage's first word to the next passage's first word
    where = np.where(np.r_[True, rows[fresh][1:] != rows[fresh][:-1]], at[rows[fresh]], starts[fresh])
    lengths = np.diff(np.r_[where, len(data)])
    kinds = np.bincount(np.repeat(filled, lengths) * 16 + _KIND[data[where[0] :]], minlength=len(x) * 16).reshape(-1, 16)[:, :KINDS]
    words_in = np.bincount(own, minlength=len(x))
    some = np.maximum(words_in, 1)
    x[:, :KINDS] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    length = ends - starts
    x[:, KINDS] = np.bincount(own, length, len(x)) / some / 10
    x[:, KINDS + 1] = np.sqrt(np.maximum(np.bincount(own, length.astype(float) ** 2, len(x)) / some - (10 * x[:, KINDS]) ** 2, 0)) / 10
    same = np.r_[False, (h[1:] == h[:-1]) & (own[1:] == own[:-1])]
    x[:, KINDS + 2] = np.bincount(own, same, len(x)) / some
    pairs = np.unique((own.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    x[:, KINDS + 3] = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=len(x)) / some
    x[:, KINDS + 4] = np.minimum(words_in, passage) / passage
    x[:, KINDS + 5] = 1.0
    signs = np.unpackbits((h & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, : PROJECTED // 8], axis=1)
    sums = np.add.reduceat(signs, fresh, axis=0, dtype=np.int32)
    x[filled, KINDS + 6 :] = 2 * sums / some[filled, None] - 1
    return x, of_row


def _forward(m: dict, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple:
    """starts: first passage of each bag; of: the bag of each passage."""
    t, g = np.tanh(x @ m["V"]), 1 / (1 + np.exp(-(x @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * x, starts, axis=0)
    return t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ m["b"], -30, 30)))


def fit(x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS) -> dict:
    """Adam on the weighted log loss of the bags. x is scaled here; the scale is part of the model."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    mean[KINDS + 5], spread[KINDS + 5] = 0, 1
    x = ((x - mean) / spread).astype(np.float64)
    rng = np.random.default_rng(5)
    m = {"V": rng.normal(0, 0.1, (SIZE, hidden)), "U": rng.normal(0, 0.1, (SIZE, hidden)), "w": rng.normal(0, 0.1, hidden), "b": np.zeros(SIZE)}
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    starts = np.searchsorted(of, np.arange(len(y)))
    for step in range(1, steps + 1):
        t, g, a, z, p = _forward(m, x, starts, of)
        d = weight * (p - y)
        dz = d[:, None] * m["b"]
        da = (dz[of] * x).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        dh = de[:, None] * m["w"]
        grads = {"b": z.T @ d + 1e-3 * m["b"], "w": (t * g).T @ de + 1e-3 * m["w"], "V": x.T @ (dh * g * (1 - t * t)) + 1e-3 * m["V"], "U": x.T @ (dh * t * g * (1 - g)) + 1e-3 * m["U"]}
        for k, v in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            m[k] = m[k] - 0.03 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "spread": spread}


def spread(bag: np.ndarray, most: int = BAG) -> np.ndarray:
    """At most so many passages of a bag, at even distances, so that a sample is bounded in memory too."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(np.int64)]


def learn(docs: DataFrame, labels: DataFrame, each: int = EACH) -> dict:
    """docs: doc_id and text; labels: doc_id and label of the learning rows."""
    rows, counts = tk.sample_by_class(labels, each)
    if not all(counts):
        return {"share": counts[1] / sum(counts) if sum(counts) else 0.5}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                x, of = encode(*tk.text_buffer(part.column("text")))
                at = tk.per_row(of, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label").cast(pa.int32()), pa.array([spread(x[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["doc_id", "label", "x"])

    got = tk.sampled_texts(docs, labels, rows).mapInArrow(run, "doc_id string, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    y = got["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return {"share": counts[1] / sum(counts)}
    bags = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in got["x"]]
    share = np.array(counts) / sum(counts)
    weight = np.where(y > 0, share[1] / y.sum(), share[0] / (len(y) - y.sum()))
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y, weight)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score of each row, and how many passages it has and the greatest attention one of them gets."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                p, n, most = score_texts(*tk.text_buffer(part.column("text")), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array(n, pa.int64()), pa.array(most, pa.float64())], ["doc_id", "score", "n_passages", "most_attention"])

    return docs.mapInArrow(run, f"doc_id {kind}, score double, n_passages bigint, most_attention double")


def score_texts(data: np.ndarray, at: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, of = encode(data, at)
    starts = np.searchsorted(of, np.arange(len(at) - 1))
    n = np.diff(np.r_[starts, len(of)])
    if "share" in model:
        return np.full(len(n), model["share"]), n, 1 / n
    _, _, a, _, p = _forward(model, (x - model["mean"]) / model["spread"], starts, of)
    return p, n, np.maximum.reduceat(a, starts)


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of rows whose remainder is not 0."""
    docs = tk.documents(spark, sf_dir)
    model = learn(docs, tk.labelled(spark, sf_dir, "quality"))
    return score(docs, model).select("doc_id", (tk.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "n_passages", "most_attention")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier accepts, with all their columns."""
    model = learn(docs, tk.labelled(spark, sf_dir, "quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                p, *_ = score_texts(*tk.text_buffer(part.column("text")), model)
                yield part.filter(pa.array(p >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
