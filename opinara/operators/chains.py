"""Hidden Markov chains of three opinions over sequences of any length.

A sequence is cut into chunks of at most `SIZE` observations. A chunk is a 3 x 3 matrix, the product of its steps, and
`FAN` consecutive matrices multiply to the one of a node above, until a sequence has one node. From there the
probabilities that come in from before and from after go down to the chunks, whose expected moves are then summed. So a
task holds chunks or the matrices of one node, never a sequence. Sequences of one chunk need none of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators.scans import running

#: Observations of a chunk, matrices of a node, chunks that are computed side by side.
SIZE, FAN, BLOCK = 1024, 1024, 512
KEYS = ("user_id", "stance")


def chunks(opinions: DataFrame, size: int = SIZE) -> DataFrame:
    """user_id, stance, node, last, codes: observations in order of time and event, `size` a row; `last` is the sequence's
    last node. Rows without a prediction, classifier or time are no observations."""
    code = (F.col("classifier_id") * 3 + F.col("predicted") + 1).cast("int")
    at = F.unix_micros(F.col("ts").cast("timestamp")) if opinions.schema["ts"].dataType.typeName().startswith("timestamp") else F.col("ts").cast("long")
    known = opinions.select(*KEYS, at.alias("at"), "event_id", code.alias("code")).where("code IS NOT NULL AND at IS NOT NULL")
    placed = running(known, "at", {"n": F.lit(1).cast("long")}, *KEYS, tie=("event_id",))
    node = F.floor((F.col("run_n") - 1) / size)
    rows = placed.groupBy(*KEYS, node.alias("node")).agg(F.max("total_n").alias("total"), F.array_sort(F.collect_list(F.struct("run_n", "code"))).alias("o"))
    return rows.select(*KEYS, "node", F.floor((F.col("total") - 1) / size).alias("last"), F.transform("o", lambda x: x["code"]).alias("codes"))


def _blocks(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows of like length, their codes side by side, and their lengths."""
    lengths = f["codes"].map(len).to_numpy()
    order = np.argsort(lengths, kind="stable")
    for i in range(0, len(order), BLOCK):
        at = order[i : i + BLOCK]
        codes = np.zeros((len(at), lengths[at].max()), int)
        for row, k in enumerate(at):
            codes[row, : lengths[k]] = f["codes"].iat[k]
        yield at, codes, lengths[at]


def _product(codes: np.ndarray, lengths: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The matrix of each chunk, up to a factor. A sequence's first observation has no move before it."""
    whole = np.broadcast_to(np.eye(3), (len(codes), 3, 3)).copy()
    for t in range(codes.shape[1]):
        e = emit[:, codes[:, t]].T[:, None, :]
        step = move * e
        if t == 0:
            step = np.where(first[:, None, None], np.eye(3) * e, step)
        then = whole @ step
        whole = np.where((t < lengths)[:, None, None], then / then.max((1, 2), keepdims=True), whole)
    return whole


def _expect(codes: np.ndarray, lengths: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward within each chunk: shares of the first state (of first chunks) and expected moves."""
    n, width = codes.shape
    came = np.zeros((width + 1, n, 3))
    came[0] = enter
    for t in range(width):
        moved = np.einsum("si,sij->sj", came[t], move)
        if t == 0:
            moved = np.where(first[:, None], enter, moved)
        x = moved * emit[:, codes[:, t]].T
        came[t + 1] = np.where((t < lengths)[:, None], x / x.sum(1, keepdims=True), came[t])
    start, pairs, after = np.zeros((n, 3)), np.zeros((n, 3, 3)), leave
    for t in range(width - 1, -1, -1):
        live = t < lengths
        weighted = emit[:, codes[:, t]].T * after
        moves = came[t][:, :, None] * move * weighted[:, None, :]
        has = live & ~first if t == 0 else live
        pairs += np.where(has[:, None, None], moves / moves.sum((1, 2), keepdims=True), 0)
        if t == 0:
            share = enter * weighted
            start = np.where(first[:, None], share / share.sum(1, keepdims=True), 0)
        before = np.einsum("sij,sj->si", move, weighted)
        after = np.where(live[:, None], before / before.max(1, keepdims=True), after)
    return start, pairs


def _up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The product of each node's matrices."""
    for f in frames:
        out = []
        for flat in f["below"]:
            whole = np.eye(3)
            for m in np.asarray(flat).reshape(-1, 3, 3):
                whole = whole @ m
                whole = whole / whole.max()
            out.append(whole.ravel())
        yield f[[*KEYS, "node"]].assign(m=out)


def _down(fan: int):
    """What enters and leaves each child of a node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for user, stance, node, flat, enter, leave in zip(*(f[c] for c in (*KEYS, "node", "below", "enter", "leave")), strict=True):
                m = np.asarray(flat).reshape(-1, 3, 3)
                came, after = [np.asarray(enter)], [np.asarray(leave)]
                for x in m[:-1]:
                    v = came[-1] @ x
                    came.append(v / v.sum())
                for x in m[:0:-1]:
                    v = x @ after[-1]
                    after.append(v / v.max())
                yield pd.DataFrame({"user_id": user, "stance": stance, "node": node * fan + np.arange(len(m)), "enter": came, "leave": after[::-1]})

    return run


def _expected(rows: DataFrame, start: dict, move: dict, emit: np.ndarray) -> DataFrame:
    """Sums of a round: of each target the first states (j is -1) and the moves, from chunks and what enters and leaves
    them; without these columns a chunk is a whole sequence."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for f in frames:
            for at, codes, lengths in _blocks(f):
                g = f.iloc[at]
                named = g["stance"].to_numpy()
                moves, first = np.stack([move[s] for s in named]), g["node"].to_numpy() == 0
                enter = np.stack(g["enter"]) if "enter" in g else np.stack([start[s] for s in named])
                leave = np.stack(g["leave"]) if "leave" in g else np.ones((len(g), 3))
                a, p = _expect(codes, lengths, first, enter, leave, moves, emit)
                for s in set(named):
                    sums[s] = sums.get(s, 0) + np.concatenate([a[named == s].sum(0)[:, None], p[named == s].sum(0)], 1)
        yield pd.DataFrame([(s, i, j - 1, float(x[i, j])) for s, x in sums.items() for i in range(3) for j in range(4)], columns=["stance", "i", "j", "n"])

    return rows.mapInPandas(step, "stance string, i int, j int, n double")


def _through(rows: DataFrame, depth: int, start: dict, move: dict, emit: np.ndarray, fan: int) -> DataFrame:
    """Chunks of long sequences with what enters and leaves each of them."""
    user = rows.schema["user_id"].dataType.simpleString()

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, codes, lengths in _blocks(f):
                g = f.iloc[at]
                m = _product(codes, lengths, g["node"].to_numpy() == 0, np.stack([move[s] for s in g["stance"]]), emit)
                yield g[[*KEYS, "node"]].assign(m=list(m.reshape(-1, 9)))

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(enter=[start[s] for s in f["stance"]], leave=[np.ones(3)] * len(f))

    matrix = f"user_id {user}, stance string, node long, m array<double>"
    ends = f"user_id {user}, stance string, node long, enter array<double>, leave array<double>"
    level, groups = rows.select(*KEYS, "node", "codes").mapInPandas(leaf, matrix), []
    for i in range(depth):
        children = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node", "m"))), lambda x: x["m"]))
        groups.append(level.groupBy(*KEYS, F.floor(F.col("node") / fan).alias("node")).agg(children.alias("below")))
        if i + 1 < depth:
            level = groups[-1].mapInPandas(_up, matrix)
    found = groups[-1].mapInPandas(top, f"user_id {user}, stance string, node long, below array<double>, enter array<double>, leave array<double>").mapInPandas(_down(fan), ends)
    for group in reversed(groups[:-1]):
        found = group.join(found, [*KEYS, "node"]).mapInPandas(_down(fan), ends)
    return rows.join(found, [*KEYS, "node"])


def hmm(opinions: DataFrame, profiles: DataFrame, rounds: int = 20, pseudo: float = 1.0, tolerance: float = 1e-3, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Transition matrices of three hidden opinions for each target, by EM with Dirichlet pseudo-counts, until no
    probability moves by more than the tolerance or `rounds` are over. Emissions are the classifiers' confusions. What comes
    to the driver are twelve sums a target. Targets are few; without opinions there are no rows."""
    known = profiles.collect()  # nine rows a classifier
    emit = np.full((3, 3 * (max(r["classifier_id"] for r in known) + 1)), 1e-12)
    for r in known:
        emit[r["actual"] + 1, r["classifier_id"] * 3 + r["predicted"] + 1] = max(r["prob"], 1e-12)
    rows = chunks(opinions, size).persist()
    ends = rows.groupBy("stance").agg(F.max("last").alias("last")).collect()  # a row a target
    stances, longest, depth = sorted(r["stance"] for r in ends), max((r["last"] for r in ends), default=0), 0
    while fan**depth <= longest:
        depth += 1
    start = {s: np.full(3, 1 / 3) for s in stances}
    move = {s: np.full((3, 3), 0.05) + 0.85 * np.eye(3) for s in stances}
    for _ in range(rounds if stances else 0):
        sums = _expected(rows.where("last = 0"), start, move, emit)
        if depth:
            sums = sums.unionAll(_expected(_through(rows.where("last > 0"), depth, start, move, emit, fan), start, move, emit))
        counts = {s: np.zeros((3, 4)) for s in stances}
        for r in sums.groupBy("stance", "i", "j").agg(F.sum("n").alias("n")).collect():
            counts[r["stance"]][r["i"], r["j"] + 1] = r["n"]
        start = {s: (c[:, 0] + pseudo) / (c[:, 0] + pseudo).sum() for s, c in counts.items()}
        before, move = move, {s: (c[:, 1:] + pseudo) / (c[:, 1:] + pseudo).sum(1, keepdims=True) for s, c in counts.items()}
        if all(np.abs(move[s] - before[s]).max() < tolerance for s in stances):
            break
    rows.unpersist()
    out = [(s, i - 1, j - 1, round(float(move[s][i, j]), 6)) for s in stances for i in range(3) for j in range(3)]
    return opinions.sparkSession.createDataFrame(out, "stance string, state int, next int, prob double")
