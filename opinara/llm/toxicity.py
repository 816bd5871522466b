"""Toxicity by the nearest labelled examples under cosine of TF-IDF vectors with weights by relevance, searched exactly.

A text's norm covers the terms of the examples only, which scales all its similarities alike.

Terms are words in lower case, hashed to 64 bits. `INDEXED` labelled rows of each class are the examples; all their terms
are the vocabulary, with document frequencies counted over all documents. A term's weight is (1 + log tf) * idf times its
relevance, the square of log2(2 + ratio of its frequencies in the two classes), which is 1 for terms that are not more
frequent in label 1 or stand in fewer than `SUPPORT` texts; it comes from a bounded sample of labelled rows, `EACH` of each
class, in which a text counts once.

The examples form an inverted index: the postings of a term are cut into blocks of `BLOCK` examples, and each block keeps
the term's greatest weight. For a query these maxima add up to an upper bound for each block; blocks are opened from the
highest bound down until the k-th neighbour found beats the next bound, so the neighbours are exact. All queries of a
slice of texts are searched together, one block each at a time. Votes are weighted by similarity. Their share becomes a
probability by logistic calibration on the examples' own votes without themselves, weighted by the classes' shares among
all learning rows. The nearest examples are the evidence.

A text without any term of the vocabulary, empty and null ones too, gets the share of label 1. Ties go to the example that
comes first in the index. Without learning rows of both classes every score is the share of label 1, or 0. An empty table
gives an empty one; long texts are one query of their size; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.decontaminate import Vocabulary

EACH, INDEXED, BLOCK, NEIGHBOURS, EVIDENCE = 3000, 512, 64, 20, 3
SUPPORT, RELEVANCE, ACCEPT, SMALL = 6, 2.0, 0.5, 1 << 18


def term_counts(data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term (its hash, or its place in the vocabulary if it is there) and count, sorted."""
    h, rows, _, _ = tk.words(data, at, sep=tk.TERM_SEP)
    if vocabulary is None:
        term = h.view(np.int64)
    else:
        term = vocabulary.find(h)
        rows, term = rows[term >= 0], term[term >= 0]
    order = np.lexsort((term, rows))
    rows, term = rows[order], term[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (term[1:] != term[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], term[first], np.diff(np.r_[first, len(rows)])


def spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from start to end of each pair, and the pair of each."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


class BlockMax:
    """Inverted lists of unit vectors in blocks of examples."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, block: int = BLOCK) -> None:
        self.block, self.blocks = block, -(-n // block)
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        cell = term * self.blocks + self.row // block
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        #: For each pair of term and block that has postings: where they begin, the block, and the greatest weight.
        self.begin, self.of = np.r_[first, len(cell)], cell[first] % self.blocks
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.first = np.searchsorted(cell[first] // self.blocks, np.arange(terms + 1))

    def search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities (n x k) of the nearest examples of n queries with positive similarity; -1 and 0 where
        there are fewer."""
        entry, of = spans(self.first[term], self.first[term + 1])
        key = row[of] * self.blocks + self.of[entry]
        order = np.argsort(key, kind="stable")
        key, entry, own = key[order], entry[order], weight[of][order]
        bound = np.bincount(key, own * self.most[entry], n * self.blocks).reshape(n, self.blocks)
        cut = np.searchsorted(key, np.arange(n * self.blocks + 1))
        ranked = np.argsort(-bound, axis=1, kind="stable")
        near, sims = np.full((n, k), -1), np.zeros((n, k))
        alive = np.arange(n)
        for i in range(self.blocks):
            b = ranked[alive, i]
            go = (bound[alive, b] > 0) & (bound[alive, b] >= sims[alive, -1] - 1e-12)
            alive, b = alive[go], b[go]
            if not len(alive):
                break
            cell = alive * self.blocks + b
            j, query = spans(cut[cell], cut[cell + 1])
            p, of = spans(self.begin[entry[j]], self.begin[entry[j] + 1])
            s = np.bincount(query[of] * self.block + self.row[p] % self.block, own[j][of] * self.weight[p], len(alive) * self.block).reshape(len(alive), self.block)
            at = np.concatenate([near[alive], np.where(s > 0, b[:, None] * self.block + np.arange(self.block), -1)], axis=1)
            s = np.concatenate([sims[alive], s], axis=1)
            best = np.lexsort((at, -np.round(s, 12)), axis=1)[:, :k]
            near[alive], sims[alive] = np.take_along_axis(at, best, 1), np.take_along_axis(s, best, 1)
        return near, sims


def weigh(row: np.ndarray, term: np.ndarray, count: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
    """Weights of unit length for each row."""
    w = (1 + np.log(count)) * worth[term]
    return w / np.maximum(np.sqrt(np.bincount(row, w * w, n)), 1e-12)[row]


def shares(near: np.ndarray, sims: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Share of label 1 among the votes."""
    return (sims * labels[near]).sum(1) / np.maximum(sims.sum(1), 1e-12)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic regression, with a little shrinkage."""
    a, w = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (p - y)) + 1e-3 * w)
    return float(w[0]), float(w[1])


def _terms(texts: DataFrame, count: bool) -> DataFrame:
    """doc_id, label and terms of each row as binary numbers; with count, rows of each label that have a term instead."""
    kind = texts.schema["doc_id"].dataType.simpleString() if not count else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                row, term, n = term_counts(*tk.text_buffer(part.column("text")))
                y = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                if count:
                    for label in (0, 1):
                        names, times = np.unique(term[y[row] == label], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), label), pa.int32()), pa.array(names, pa.int64()), pa.array(times, pa.int64())], ["label", "term", "n"])
                else:
                    at = tk.per_row(row, part.num_rows)
                    cut = lambda v: pa.array([v[a:b].astype("<i8").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), cut(term), cut(n)], ["doc_id", "label", "term", "n"])

    return texts.mapInArrow(run, "label int, term long, n long" if count else f"doc_id {kind}, label int, term binary, n binary")


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Rows, and rows that have each term, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of 2 * INDEXED rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                df += np.bincount(term_counts(*tk.text_buffer(part.column("text")), shared.value)[1], minlength=len(df))
                n += part.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int64()), pa.array(np.r_[n, df[some]], pa.int64())], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a term
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[got["term"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return int(df[-1]), df[:-1]


def relevance(with_term: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """with_term: (2, terms) rows of each class that have a term; rows: rows of each class."""
    ratio = (with_term[1] / rows[1]) / np.maximum(with_term[0], 1) * rows[0]
    return np.where(ratio > 1, np.log2(2 + ratio), 1.0) ** RELEVANCE


def learn(docs: DataFrame, labels: DataFrame, each: int = EACH, indexed: int = INDEXED, neighbours: int = NEIGHBOURS) -> dict:
    rows, counts = tk.sample_by_class(labels, each)
    if not all(counts):
        return {"share": counts[1] / sum(counts) if sum(counts) else 0.0}
    share = counts[1] / sum(counts)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = [r for c in (0, 1) for r in [r for r in rows if r[1] == c][:indexed]]
    distinct = tk.sampled_texts(docs, labels, rows).groupBy("text", "label").count().select("text", "label")
    distinct = tk.checkpointed(distinct)
    seen = dict(distinct.groupBy("label").count().collect())
    got = _terms(distinct, True).groupBy("term").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    got = got.where(F.col("n0") + F.col("n1") >= SUPPORT).toPandas()  # from the bounded sample
    ranks = {r[0]: i for i, r in enumerate(chosen)}
    examples = _terms(tk.sampled_texts(docs, labels, chosen), False).collect()  # 2 * INDEXED rows
    examples.sort(key=lambda r: (ranks[r["doc_id"]], bytes(r["term"]), bytes(r["n"])))
    y = np.array([r["label"] for r in examples])
    if not 0 < y.sum() < len(y) or not all(seen.get(c) for c in (0, 1)):
        return {"share": share}
    hashes = [np.frombuffer(r["term"], "<i8").view(np.uint64) for r in examples]
    vocabulary = Vocabulary(np.concatenate(hashes))
    total, df = frequencies(docs, vocabulary)
    worth = np.maximum(np.log((1 + total) / (1 + df)), 1e-3)
    place = vocabulary.find(got["term"].to_numpy(np.int64).view(np.uint64))
    more = relevance(np.stack([got["n0"], got["n1"]]).astype(float), np.array([seen[0], seen[1]], float))
    worth[place[place >= 0]] *= more[place >= 0]
    of = np.repeat(np.arange(len(y)), [len(h) for h in hashes])
    term, n = vocabulary.find(np.concatenate(hashes)), np.concatenate([np.frombuffer(r["n"], "<i8") for r in examples])
    weight = weigh(of, term, n, worth, len(y))
    # neighbours in the index share their heaviest term, so that blocks differ in their bounds
    heaviest = np.full(len(y), -1)
    order = np.lexsort((term, weight))
    heaviest[of[order]] = term[order]
    rank = np.argsort(np.lexsort((np.arange(len(y)), heaviest, y)))
    order = np.argsort(rank)
    index = BlockMax(rank[of], term, weight, len(y), len(vocabulary))
    y = y[order]
    by_rank = np.lexsort((term, rank[of]))
    near, sims = index.search(rank[of][by_rank], term[by_rank], weight[by_rank], len(y), neighbours + 1)
    # an example does not vote on itself or on its copies
    sims = np.where((near == np.arange(len(y))[:, None]) | (sims > 1 - 1e-9), 0.0, sims)
    each_weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    return {"vocabulary": vocabulary, "worth": worth, "index": index, "labels": y, "ids": [examples[i]["doc_id"] for i in order], "share": share, "line": calibrate(shares(near, sims, y), y, each_weight)}


def score_texts(data: np.ndarray, at: np.ndarray, model: dict, k: int = NEIGHBOURS) -> tuple[np.ndarray, list[list[tuple]]]:
    """Scores and evidence."""
    n = len(at) - 1
    if "index" not in model:
        return np.full(n, model["share"]), [[]] * n
    row, term, count = term_counts(data, at, model["vocabulary"])
    near, sims = model["index"].search(row, term, weigh(row, term, count, model["worth"], n), n, k)
    a, b = model["line"]
    p = np.where(sims[:, 0] > 0, 1 / (1 + np.exp(-np.clip(a + b * shares(near, sims, model["labels"]), -30, 30))), model["share"])
    return p, [[(model["ids"][i], float(s), int(model["labels"][i])) for i, s in zip(x[:EVIDENCE].tolist(), y[:EVIDENCE].tolist(), strict=True) if s > 0] for x, y in zip(near, sims, strict=True)]


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    field = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * INDEXED examples and their terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text", SMALL):
                scores, evidence = score_texts(*tk.text_buffer(part.column("text")), shared.value, k)
                kind = pa.list_(pa.struct([("doc_id", part.column("doc_id").type), ("similarity", pa.float64()), ("label", pa.int32())]))
                found = pa.array([[{"doc_id": d, "similarity": s, "label": v} for d, s, v in e] for e in evidence], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), found], ["doc_id", "score", "evidence"])

    return docs.mapInArrow(run, f"doc_id {field}, score double, evidence array<struct<doc_id:{field},similarity:double,label:int>>")


def op7_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of rows whose remainder is not 0."""
    docs = tk.documents(spark, sf_dir)
    model = learn(docs, tk.labelled(spark, sf_dir, "toxic"))
    return score(docs, model).select("doc_id", (tk.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "evidence")
