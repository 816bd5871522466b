"""How filters of documents interact, in every order.

Five filters are judged once for each text as a mask of failures: A too few words, B too few distinct words, C too many
capitals, D code marks, E a copy of a text with a smaller id. Copies are found by a fingerprint-routed RDD: texts go to
partitions by their xxhash; where hashes meet, a chain holds each different full text with its least id, and all other
ids fail E. Before they are routed, tasks reduce the texts that they have read, a few megabytes at a time, to one record
a text, so a text that a third of all rows share is sent once for each such portion. Masks are counted by combineByKey
as vectors, from which the counts of all orders and steps follow: no order reads the documents again.

Nulls: a null text is empty; a null language is the empty text; a row without id fails no E and makes no other fail. Rows
that share the least id of a text do not fail E. A document with several label rows counts as good or toxic if one says
so. Texts are compared whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, permutations

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text that a task holds before it sends what it has.
HOLD = 16 << 20
#: Bytes of text, before compression and with all copies, for each partition of the routed texts.
PARTITION_BYTES = 32 << 20

# Limits of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes that go on with a code point rather than begin one.
CONTINUING = bytes(range(0x80, 0xC0))


def mask_of(data: bytes) -> int:
    """Failures of A to D, a bit each, of a text in UTF-8."""
    words = data.split()  # bytes are split at space and U+0009 to U+000D alone
    points = len(data.translate(None, CONTINUING))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * points,
        len(data.translate(None, MARKS)) < len(data),
    )
    return sum(1 << i for i, fail in enumerate(fails) if fail)


class Chain:
    """The different texts of one hash, each as a link: text, mask, least id, rows with that id by part."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, data: bytes, mask: int | None, key: int, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
        """Takes rows of a text, and gives those that it now knows to be copies: id, part, mask, rows."""
        link = next((x for x in self.links if x[0] == data), None)
        if link is None:
            self.links.append([data, mask_of(data) if mask is None else mask, key, Counter(parts)])
        elif key == link[2]:
            link[3].update(parts)
        else:
            if key < link[2]:
                key, link[2], parts, link[3] = link[2], key, link[3], Counter(parts)
            yield from ((key, part, link[1] | COPY, n) for part, n in parts.items())


def route(rows: Iterator, hold: int = HOLD) -> Iterator[tuple[int, tuple]]:
    """(id, text, part) rows to (xxhash, (compressed text, mask, id, rows by part)), one for each text of a portion. Rows
    that the portion itself shows to be copies go without a text, by a hash of their id, so that they are spread."""

    def sent(chains: dict[int, Chain]) -> Iterator[tuple[int, tuple]]:
        for h, chain in chains.items():
            for data, mask, key, parts in chain.links:
                yield h, (zstandard.compress(data, 1), mask, key, dict(parts))

    held, chains = 0, {}
    for i, (key, text, part) in enumerate(rows):
        data = (text or "").encode()
        if key is None:
            yield i * 0x9E3779B1 % (1 << 32), (None, mask_of(data), None, {part: 1})
            continue
        h = xxhash.xxh3_64_intdigest(data)
        chain = chains.setdefault(h, Chain())
        links = len(chain.links)
        for other, p, mask, n in chain.add(data, None, key, {part: 1}):
            yield xxhash.xxh3_64_intdigest(str(other).encode()), (None, mask, other, {p: n})
        held += (len(data) + 300) * (len(chain.links) - links)
        if held >= hold:
            yield from sent(chains)
            held, chains = 0, {}
    yield from sent(chains)


def judged(records: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """Records in order of their hash to (id, part, mask, rows); one chain is held at a time."""
    for _, group in groupby(records, key=lambda r: r[0]):
        chain = Chain()
        for _, (blob, mask, key, parts) in group:
            if blob is None:
                yield from ((key, part, mask, n) for part, n in parts.items())
            else:
                yield from chain.add(zstandard.decompress(blob), mask, key, parts)
        for _, mask, key, parts in chain.links:
            yield from ((key, part, mask, n) for part, n in parts.items())


def masks(docs: DataFrame, partitions: int | None = None, hold: int = HOLD) -> RDD:
    """(id, part, mask, rows) of all documents, rows with equal values possibly in several records. Without `partitions`
    there are as many as the texts have PARTITION_BYTES."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(""))).rdd
    size = 0 if partitions else docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = partitions or 1 + size // PARTITION_BYTES
    routed = rows.mapPartitions(lambda part: route(part, hold))
    # sorted within its memory limit or on disk, so that a partition may be larger than memory
    return routed.repartitionAndSortWithinPartitions(n, lambda h: h % n).mapPartitions(judged)


def vectors(counted: RDD) -> RDD:
    """part to counts of masks: all rows, good ones, toxic ones. counted: (part, mask, rows, good, toxic)."""

    def put(v: np.ndarray, x: tuple[int, int, bool, bool]) -> np.ndarray:
        mask, n, good, toxic = x
        v[0, mask] += n
        v[1, mask] += n * bool(good)
        v[2, mask] += n * bool(toxic)
        return v

    fresh = lambda x: put(np.zeros((3, 1 << len(FILTERS)), np.int64), x)
    return counted.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(fresh, put, lambda a, b: a + b, max(1, min(32, counted.getNumPartitions())))


def report(part: str, v: np.ndarray) -> Iterator[tuple]:
    """A row for each order and step, from the counts of masks."""
    mask = np.arange(v.shape[1])
    fails = [mask >> i & 1 == 1 for i in range(len(FILTERS))]
    rows, shapley = [], Counter()
    for order in permutations(range(len(FILTERS))):
        left = np.ones(len(mask), bool)
        for step, f in enumerate(order, 1):
            gone = left & fails[f]
            again = ~left & fails[f]
            left &= ~fails[f]
            removed = v[:, gone].sum(1)
            shapley[f] += int(removed[0])
            rows.append((order, step, f, int(v[0, left].sum()), removed, int(v[0, again].sum())))
    for order, step, f, kept, removed, redundant in rows:
        yield part, "".join(FILTERS[i] for i in order), step, kept, int(removed[0]), redundant, int(v[0, 1 << f]), int(removed[1]), int(removed[2]), shapley[f]


COLUMNS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(docs: DataFrame, labels: DataFrame, partitions: int | None = None, hold: int = HOLD) -> DataFrame:
    """docs: doc_id, text, lang; labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = spark.createDataFrame(masks(docs, partitions, hold), "doc_id bigint, part string, mask int, n bigint", verifySchema=False)
    rows = each.join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic").rdd
    return spark.createDataFrame(vectors(rows).flatMap(lambda x: report(*x)), COLUMNS, verifySchema=False)


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    return audit(tk.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP11_SQL = f"""
WITH t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), known AS (
    SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           map {{'A': len(words) < {LEAST_WORDS}, 'B': 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words),
                'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {CAPITAL_PERCENT} * length(text),
                'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(least < t.doc_id, false)}} AS fail
    FROM t LEFT JOIN known USING (doc_id)
), counted AS (
    SELECT part, fail, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), judged AS (
    SELECT part, filter_order, step, s.f, n, good, toxic, fail[s.f] AS fails,
           len(list_filter(string_split(before, ''), lambda x: x <> '' AND coalesce(fail[x], false))) > 0 AS earlier,
           len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fail[x])) = 1 AS alone
    FROM counted, steps s
), summed AS (
    SELECT part, filter_order, cast(step AS INT) AS step, f,
           sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant, cast(unique_fails AS BIGINT) AS unique_fails,
       cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed
"""
