"""Personal data by weak supervision.

Candidate spans of four kinds come from strict patterns (the base) and from looser ones. Six labelers vote on each
candidate (-1, 0 for no vote, 1): pattern, checksum or range, number of digits, gazetteer, words nearby, words nearby
that speak against it. Expectation-maximisation over the counts of vote patterns in the whole table estimates how
reliable each labeler is and how likely each candidate is real; a logistic span classifier is then trained on those
probabilities. Base spans always stay; looser ones stay if the classifier gives them `threshold` or more and they do not
overlap a base span.

A null text is the empty text; rows are handled one by one, so repeated rows repeat; an empty table gives an empty one;
long texts take linear time; of spans that begin alike the kind listed first comes first; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
THRESHOLD = 0.5
NEAR = 48
#: What is expected of labelers (shares of votes -1, 0, 1 on false and on real candidates), and its weight against the data.
EXPECTED, ANCHOR = np.array([[0.55, 0.4, 0.05], [0.05, 0.35, 0.6]]), 0.1

# Patterns, gazetteers and context words.
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,64})+"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"),
}
#: Generic top-level domains; any two letters are a country's.
DOMAINS = frozenset("com org net edu gov int mil info biz name pro coop museum aero jobs mobi travel tel cat asia post xxx app dev page blog shop store online site website tech cloud digital email news media agency studio design art music video live world global group company solutions services systems software network team work academy school university center club community social xyz top icu vip".split())
#: Country calling codes: one digit, two digits, and the two digits with which three-digit codes begin.
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: First digits of issuers' numbers; those from 2221 to 2720 and from 3528 to 3589 by rule.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "644", "645", "646", "647", "648", "649", "65", "62", "36", "38", "300", "301", "302", "303", "304", "305", *map(str, range(2221, 2721)), *map(str, range(3528, 3590)))
FOR = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|login|adresse", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|\btel|fax|mobile|telefon|appel|llam", re.I),
}
AGAINST = re.compile(r"version|release|isbn|issn|serial|order|invoice|section|figure|example|\bdoi\b|\bv$", re.I)
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """Every @ is tried once with all that can stand before it, so long words cost linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in EMAIL_LEFT:
            left -= 1
        m = HOST.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Dotted runs of numbers are taken four at a time from the left."""
    out = []
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                out.append((start, end))
            start = end + 1
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, end; by start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        spans += [(a, 1, b) for a, b in ips(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 2 * 19 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(spans)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that overlap no base span."""
    found = []
    if "at)" in text or "at]" in text:
        found += [(m.start(), 0, m.end()) for m in LOOSE["email"].finditer(text)]
    if re.search("[0-9]{3}", text):
        for k in (2, 3):
            found += [(m.start(), k, m.end()) for m in LOOSE[KINDS[k]].finditer(text)]
    starts = [x[0] for x in base]
    ends = list(accumulate((x[2] for x in base), max))  # the furthest end of all spans up to each
    out = []
    for span in sorted(found):
        before = bisect_left(starts, span[2])
        if not before or ends[before - 1] <= span[0]:
            out.append(span)
    return out


def votes(text: str, span: tuple[int, int, int], strict: bool) -> int:
    """The labelers' votes on a candidate as one number, a digit of base 3 for each."""
    start, kind, end = span
    own, digits = text[start:end], digits_of(text[start:end])
    before, near = text[max(0, start - NEAR) : start], text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    name = KINDS[kind]
    cast = [1 if strict else -1, 0, 0, 0, 0, 0]
    if name == "card":
        cast[1] = 1 if luhn(digits) else -1
        cast[3] = 1 if digits.startswith(ISSUERS) else -1
    elif name == "ip":
        cast[1] = -1 if own.startswith(("0.", "127.", "255.")) else 1
        cast[3] = -1 if own.startswith(("10.", "192.168.")) else 0
    elif name == "phone":
        cast[3] = 1 if own.startswith("+") and digits.startswith(CALLING) else 0
    else:
        last = re.split(r"[^A-Za-z]+", own.rstrip(".-0123456789"))[-1].lower()
        cast[3] = 1 if len(last) == 2 or last in DOMAINS else -1
    if name in ("card", "phone"):
        low, high = (14, 19) if name == "card" else (10, 15)
        cast[2] = 1 if low <= len(digits) <= high else -1
    cast[4] = 1 if FOR[name].search(near) else 0
    cast[5] = -1 if AGAINST.search(before) else 0
    code = 0
    for v in cast:
        code = code * 3 + v + 1
    return code


def unpack(code: np.ndarray) -> np.ndarray:
    """Votes -1, 0, 1 of each labeler, from codes."""
    return np.stack([code // 3 ** (LABELERS - 1 - i) % 3 - 1 for i in range(LABELERS)], axis=-1)


def reliabilities(pattern: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """EM of two classes with independent labelers: probability of each pattern, P(vote | class) and the prior."""
    v = unpack(pattern) + 1
    real = np.clip(0.5 + 0.12 * unpack(pattern).sum(1), 0.05, 0.95)
    table, prior = np.zeros((2, LABELERS, 3)), 0.5
    for _ in range(rounds):
        prior = (weight @ real + 1) / (weight.sum() + 2)
        for c, p in enumerate((1 - real, real)):
            for j in range(LABELERS):
                # labelers are held to be better than chance, as two clusters of votes alone do not say which one is real
                count = np.bincount(v[:, j], weight * p, 3) + 0.5 + ANCHOR * weight.sum() * EXPECTED[c]
                table[c, j] = count / count.sum()
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, v[:, j]] / table[0, j, v[:, j]]) for j in range(LABELERS))
        real = np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 1e-6, 1 - 1e-6)
    said = np.stack([[np.bincount(v[:, j], weight * p, 3) + 0.5 for j in range(LABELERS)] for p in (1 - real, real)])
    return real, said / said.sum(2, keepdims=True), float(prior)


def features(kind: np.ndarray, pattern: np.ndarray, size: np.ndarray) -> np.ndarray:
    one = np.eye(len(KINDS))[kind]
    v = unpack(pattern)
    return np.concatenate([np.ones((len(kind), 1)), one, v == 1, v == -1, np.minimum(size, 8)[:, None] / 8.0], axis=1)


def train(groups: list[tuple[int, int, int, int]], rounds: int = 400) -> dict[tuple[int, int, int], float]:
    """The classifier's probability for each (kind, votes, size) among the groups, which come with counts."""
    if not groups:
        return {}
    kind, pattern, size, n = (np.array(x, np.int64) for x in zip(*groups, strict=True))
    target = np.zeros(len(n))
    for k in np.unique(kind):
        own = kind == k
        target[own] = reliabilities(pattern[own], n[own].astype(float))[0]
    x = features(kind, pattern, size)
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (share * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (share * (p - target)) + 1e-4 * w)
        w -= 0.5 * step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {g[:3]: float(q) for g, q in zip(groups, p, strict=True)}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: base spans and all candidates as arrays of numbers."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["first", "last", "kind", "strict", "votes", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                columns: list[list[list[int]]] = [[] for _ in names]
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    loose = loose_spans(text, base)
                    rows = [(a, b, k, s, votes(text, (a, k, b), bool(s)), min(8, (b - a) // 4)) for spans, s in ((base, 1), (loose, 0)) for a, k, b in spans]
                    for i, c in enumerate(columns):
                        c.append([r[i] for r in rows])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["doc_id", *names])

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} array<int>" for x in names))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans with the classifier's probabilities."""
    found = tk.checkpointed(candidates(docs, id_col, text_col))
    groups = (
        found.where(F.size("kind") > 0)
        .select(F.explode(F.arrays_zip("kind", "votes", "size")).alias("c"))
        .groupBy("c.kind", "c.votes", "c.size")
        .count()
        .collect()  # at most kinds x vote patterns x sizes
    )
    chance = train(sorted(tuple(r) for r in groups))
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            rows = zip(*(batch.column(x).to_pylist() for x in ("first", "last", "kind", "strict", "votes", "size")), strict=True)
            for row in rows:
                spans = sorted((a, k, b, s, chance[k, v, n]) for a, b, k, s, v, n in zip(*row, strict=True))
                base = [x for x in spans if x[3]]
                kept = [x for x in spans if x[3] or x[4] >= threshold]
                said = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in xs)
                for i in range(4):
                    out[i].append(sum(x[1] == i for x in base))
                out[4].append(hashlib.sha256(said(base).encode()).hexdigest())
                out[5].append(said(kept))
                out[6].append([x[4] for x in kept])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "chances"])

    return found.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, chances array<double>")


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find(tk.documents(spark, sf_dir))
