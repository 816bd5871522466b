"""Secrets in texts, by grammars inferred from labelled credentials.

Three strict patterns give the base: values assigned to telling names, access keys, long hexadecimal numbers. Their values
are the labelled credentials. For each kind, and for candidates that no pattern labels, a probabilistic automaton is
inferred: the prefix tree of the values, in which states are merged as long as their ends and next characters do not
differ by more than a Hoeffding bound, and their successors with them. Every other token of TOKEN characters or more that
overlaps no base span is then a candidate, scored by its log-likelihood under a kind's automaton less that under the
automaton of unlabelled candidates, for each character; it is added if it reaches what most labelled values of the kind
reach that were held out from the inference.

Automata are fitted on at most `sample` different values a kind (half of them set the kind's limit), those with the least hash, of LONGEST characters at most; every text is searched whole and every candidate scored
whole. A null text is the empty text; rows are handled one by one, so repeated rows repeat; an empty
table gives an empty one, and without labelled values nothing is added; long texts take linear time; of spans that begin
alike the kind listed first comes first, of kinds that score alike too; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

KINDS = ("assign", "access", "hex")
#: Of candidates that no pattern labels.
OTHER = len(KINDS)
TOKEN, LONGEST, SAMPLE = 16, 256, 400
#: Confidence of the Hoeffding bound; share of probability for characters that a state has not seen.
ALPHA, UNSEEN = 0.05, 0.02
#: A kind's limit of log-odds a character is at least MARGIN, and SLACK times what FOUND_SHARE of held-out labelled values reach:
#: unlabelled secrets score a little less, as the automaton of unlabelled candidates has seen some of them.
MARGIN, FOUND_SHARE, SLACK = 0.2, 0.95, 0.7

# The patterns.
NAMES = ("password", "passwd", "secret", "token", "api")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{TOKEN},}}")
SYMBOLS = 68


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Start, number of the kind, end, credential; by start, then kind."""
    spans, low = [], text.lower()
    if any(x in low for x in NAMES):
        spans += [(m.start(), 0, m.end(), m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(spans)


def other_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens that overlap no base span."""
    starts = [x[0] for x in base]
    ends = list(accumulate((x[2] for x in base), max))
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append((m.start(), OTHER, m.end(), m.group()))
    return out


class Automaton:
    """A prefix tree with counts, whose states are merged while they are alike."""

    def __init__(self, values: list[str], alpha: float = ALPHA) -> None:
        self.n, self.ends, self.next, self.taken = [0], [0], [{}], [{}]
        for value in values:
            self._insert(value)
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._settle()

    def _insert(self, value: str) -> None:
        state = 0
        for c in value:
            self.n[state] += 1
            self.taken[state][c] = self.taken[state].get(c, 0) + 1
            if c not in self.next[state]:
                self.next[state][c] = len(self.n)
                self.n.append(0)
                self.ends.append(0)
                self.next.append({})
                self.taken.append({})
            state = self.next[state][c]
        self.n[state] += 1
        self.ends[state] += 1

    def _alike(self, a: int, b: int) -> bool:
        """Whether no share differs by more than chance, in these states and all that can follow in both."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.n[a], self.n[b]
            limit = self.width * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > limit:
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if abs(self.taken[a].get(c, 0) / n - self.taken[b].get(c, 0) / m) > limit:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds state b, still the root of a tree, to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.ends[a] += self.ends[b]
            for c, k in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + k
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        kept, fixed = [0], {0}
        while edge := max(((self.n[t], -s, c) for s in kept for c, t in self.next[s].items() if t not in fixed), default=None):
            state, c = -edge[1], edge[2]
            b = self.next[state][c]
            for a in kept:
                if self._alike(a, b):
                    self.next[state][c] = a
                    self._fold(a, b)
                    break
            else:
                kept.append(b)
                fixed.add(b)
        self.states = len(kept)

    def _settle(self) -> None:
        """Log-probabilities; what a state has not seen leads back to the start."""
        seen = lambda k, n: math.log((1 - UNSEEN) * k / n) if k else math.log(UNSEEN / (SYMBOLS + 1))
        self.unseen = seen(0, 1)
        self.step = [{c: (self.next[s][c], seen(k, self.n[s])) for c, k in self.taken[s].items()} for s in range(len(self.n))] if self.n[0] else [{}]
        self.end = [seen(self.ends[s], max(1, self.n[s])) for s in range(len(self.n))]
        if self.n[0]:
            self._drop_unreached()
        del self.next, self.taken

    def _drop_unreached(self) -> None:
        order, at = [0], {0: 0}
        for s in order:
            for t, _ in self.step[s].values():
                if t not in at:
                    at[t] = len(order)
                    order.append(t)
        self.step = [{c: (at[t], p) for c, (t, p) in self.step[s].items()} for s in order]
        self.end = [self.end[s] for s in order]

    def log_likelihood(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            state, p = self.step[state].get(c, (0, self.unseen))
            total += p
        return total + self.end[state]


class Model:
    """Automata of the kinds that have labelled values and of unlabelled candidates, and a limit of log-odds a kind, which
    follows from what its values that were held out reach. Unlabelled values may hold secrets, so they set no limit, and
    those that are found to be secrets are left out when their automaton is inferred again, a few rounds at most."""

    def __init__(self, values: dict[int, list[str]], rounds: int = 5) -> None:
        self.kinds = {k: Automaton(v[::2]) for k, v in sorted(values.items()) if k != OTHER and v}
        others = values.get(OTHER, [])
        for _ in range(rounds):
            self.other, self.limits = Automaton(others), {}
            for k in self.kinds:
                tried = sorted(self._odds(k, v) for v in values[k][1::2] or values[k])
                self.limits[k] = max(MARGIN, SLACK * tried[int(len(tried) * (1 - FOUND_SHARE))])
            left = [v for v in others if not self.judge(v)]
            if len(left) == len(others):
                break
            others = left

    def _odds(self, kind: int, value: str) -> float:
        return (self.kinds[kind].log_likelihood(value) - self.other.log_likelihood(value)) / (len(value) + 1)

    def judge(self, value: str) -> tuple[float, int] | None:
        """Log-odds a character and kind, of the kind that exceeds its limit most; none if no kind does."""
        own = max(((odds - self.limits[k], -k, odds) for k in self.kinds if (odds := self._odds(k, value)) >= self.limits[k]), default=None)
        return own and (own[2], -own[1])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row all base spans and other candidates as arrays: first, last, kind, value."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = [pa.list_(pa.int32())] * 3 + [pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    rows.append(base + other_spans(text, base))
                columns = [pa.array([[x[i] for x in r] for r in rows], k) for i, k in zip((0, 2, 1, 3), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "first", "last", "kind", "value"])

    return docs.mapInArrow(run, f"doc_id {id_type}, first array<int>, last array<int>, kind array<int>, value array<string>")


def learn(found: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` different values of each kind, twice as many without a label; those with the least hash."""
    values = found.select(F.explode(F.arrays_zip("kind", "value")).alias("c")).select("c.kind", "c.value").where(F.length("value") <= LONGEST).distinct()
    values = tk.stored(values)
    chosen = {}
    for kind in range(OTHER + 1):
        most = sample if kind != OTHER else 2 * sample
        rows = values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(most).collect()
        chosen[kind] = [r["value"] for r in rows]
    return Model(chosen)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans, and the log-odds of those that are added."""
    found = tk.stored(candidates(docs, id_col, text_col))
    model = learn(found, sample)
    id_type = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in zip(*(batch.column(x).to_pylist() for x in ("first", "last", "kind", "value")), strict=True):
                base, added = [], []
                for first, last, kind, value in zip(*row, strict=True):
                    if kind != OTHER:
                        base.append((first, kind, last))
                    elif judged := model.judge(value):
                        added.append((first, judged[1], last, judged[0]))
                for i in range(3):
                    out[i].append(sum(x[1] == i for x in base))
                out[3].append(hashlib.sha256(said(base).encode()).hexdigest())
                out[4].append(said(sorted(base + added)))
                out[5].append([x[3] for x in added])
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "added_log_odds"])

    return found.mapInArrow(run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, added_log_odds array<double>")


def op12_secret_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find(tk.documents(spark, sf_dir))
