"""Inverted lists in shuffle order: rows of one token stand together in a partition and are read as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

WIDE, CELL, HELD = 16, 2048, 1 << 15


def by_token(frame: DataFrame, *then: str) -> DataFrame:
    return frame.repartition("token").sortWithinPartitions("token", *then)


def shared_lists(tokens: DataFrame, meets: Callable[[np.ndarray, np.ndarray], np.ndarray], wide: int = WIDE) -> DataFrame:
    """token, sig, n of the lists with at least two members, and their lead: the least member, of lists that are longer than
    `HELD` the least of those that come first. Spark sorts by the token alone, which is one number; members are put in order here.
    Of lists of up to `wide` members only those that meet another (a function of the n of both) are given, so that lists
    shared by chance, whose number grows with the square of the input, end here."""

    names = ["token", "sig", "n", "lead", "lead_n"]

    def lists(t: np.ndarray, s: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        # lists of one member end here, before the others are put in order
        same = t[1:] == t[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        t, s, n = t[shared], s[shared], n[shared]
        order = np.lexsort((s, t))
        t, s, n = t[order], s[order], n[order]
        lead = np.searchsorted(t, t)
        return [t, s, n, s[lead], n[lead]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last list waits, as it may go on; one that goes on and on is passed on with the lead of its first rows
        held, waiting, endless = [[np.zeros(0, np.int64)] * 3], 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(c).to_numpy() for c in ("token", "sig", "n")])
                waiting += batch.num_rows
                if waiting < HELD:
                    continue
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            if endless is not None and len(c[0]):
                of = int(np.searchsorted(c[0], endless[0], "right"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(x[:of] for x in c), *(np.full(of, v) for v in endless[1:]))], names)
                endless = endless if of == len(c[0]) else None
                c = [x[of:] for x in c]
            cut = int(np.searchsorted(c[0], c[0][-1])) if len(c[0]) else 0
            go_on = batch is not None and len(c[0]) - cut >= HELD
            if batch is None or go_on:
                cut = len(c[0])
            if cut:
                out = lists(*(x[:cut] for x in c))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
                endless = (out[0][-1], out[3][-1], out[4][-1]) if go_on else endless
            held, waiting = [[x[cut:] for x in c]], 0

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_list = [np.zeros(0, np.int64)] * 5, None

        def keep(c: list[np.ndarray], more: bool) -> pa.RecordBatch:
            t, n = c[0], c[2]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            size = np.diff(np.r_[first, len(t)])
            long = (size > wide) | (t[first] == open_list if open_list is not None else False)
            long[-1] |= more
            ok = np.repeat(long, size)
            at = np.flatnonzero(~ok)
            end = np.repeat(first + size, size)
            for d in range(1, wide):
                at = at[at + d < end[at]]
                if not len(at):
                    break
                both = at[meets(n[at], n[at + d])]
                ok[both] = ok[both + d] = True
            return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in c], names)

        for batch in batches:
            c = [np.r_[h, batch.column(x).to_numpy()] for h, x in zip(held, names, strict=True)]
            if not len(c[0]):
                continue
            # the last list may go on; once it is known to be wide, it is passed on as it comes
            cut = int(np.searchsorted(c[0], c[0][-1]))
            more = len(c[0]) - cut > wide or c[0][-1] == open_list
            cut = len(c[0]) if more else cut
            if cut:
                yield keep([x[:cut] for x in c], more)
                open_list = c[0][-1] if more else None
            held = [x[cut:] for x in c]
        if len(held[0]):
            yield keep(held, False)

    return by_token(tokens).mapInArrow(lambda batches: met(run(batches)), "token long, sig long, n long, lead long, lead_n long")


def crossing(members: DataFrame, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], may_link: Callable | None = None, sketches: DataFrame | None = None, nearest: bool = False, wide: int = WIDE, cell: int = CELL, gap: Callable | None = None) -> DataFrame:
    """members: what `mixed` gives. Pairs of a list that are in different components and fit, a function of the n of both.
    may_link: of the n of both and of the number of bits in which their sketches differ; asked in lists of more than
    `wide` members, which carry them. sketches: sig and sketch, whose sizes are powers of two and at most double within
    a link. gap: a difference of the n of both, in place of sketches. nearest: wide lists only, and of each member only the
    pair with the least difference. A list of more than
    `cell` members is cut into blocks, and pairs of blocks are compared in separate tasks."""

    def narrow(t: np.ndarray, s: np.ndarray, n: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        # the members of a list stand by root: each is compared with the members d places behind the end of its own root
        end = np.searchsorted(t, t, "right") if len(t) else t
        change = np.flatnonzero(np.r_[(t[1:] != t[:-1]) | (root[1:] != root[:-1]), True]) + 1 if len(t) else t
        other = change[np.searchsorted(change, np.arange(len(t)), "right")] if len(t) else t
        at = np.arange(len(t))
        while len(at := at[other[at] < end[at]]):
            to = other[at]
            ok = fits(n[at], n[to])
            if ok.any():
                yield _pairs(s[at[ok]], s[to[ok]])
            other[at] += 1

    def run_narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            new = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("token", "sig", "n", "root"), strict=True)]
            cut = int(np.searchsorted(new[0], new[0][-1])) if len(new[0]) else 0
            yield from narrow(*(c[:cut] for c in new))
            held = [c[cut:] for c in new]
        yield from narrow(*held)

    def wide_cell(rows: list[tuple], diagonal: bool) -> Iterator[pa.RecordBatch]:
        side, sig, n, root = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        sizes = np.array([len(r[4] or b"") for r in rows])
        bits = [np.frombuffer(r[4] or b"", np.uint64) for r in rows]
        for size in np.unique(sizes):
            # a sketch is compared with those of its own size, and twice as long ones folded to it
            small = np.flatnonzero(sizes == size)
            for double in (False, True):
                large = np.flatnonzero(sizes == size * 2) if double else small
                if double and size == 0 or not len(large):
                    continue
                x = np.stack([bits[i] for i in small])
                y = np.stack([bits[i] for i in large])
                y = y[:, : x.shape[1]] ^ y[:, x.shape[1] :] if double else y
                for i in range(0, len(small), 64):
                    own = small[i : i + 64]
                    ok = (root[own][:, None] != root[large]) & fits(n[own][:, None], n[large])
                    if not diagonal:
                        ok &= side[own][:, None] != side[large]
                    if not double:
                        ok &= own[:, None] < large
                    p, q = np.nonzero(ok)
                    if not len(p):
                        continue
                    if gap:
                        difference = gap(n[own[p]], n[large[q]])
                    else:
                        difference = np.concatenate([np.bitwise_count(x[i + p[k : k + 8192]] ^ y[q[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, len(p), 8192)])
                    good = may_link(n[own[p]], n[large[q]], difference) if may_link else np.ones(len(p), bool)
                    p, q, difference = p[good], q[good], difference[good]
                    if nearest and len(p):
                        order = np.lexsort((difference, p))
                        first = order[np.r_[True, p[order][1:] != p[order][:-1]]]
                        p, q = p[first], q[first]
                    if len(p):
                        yield _pairs(sig[own[p]], sig[large[q]])

    def run_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("token", "i", "j", "side", "sig", "n", "root", "sketch")]
            for token, i, j, *row in zip(*columns, strict=True):
                if (token, i, j) != now:
                    if held:
                        yield from wide_cell(held, now[1] == now[2])
                    now, held = (token, i, j), []
                held.append(row)
        if held:
            yield from wide_cell(held, now[1] == now[2])

    large = members.where(F.col("size") > wide)
    large = large.join(sketches.select("sig", "sketch"), "sig") if sketches is not None else large.withColumn("sketch", F.lit(None).cast("binary"))
    # a member stands in the cells of its block with each other block
    blocks = F.ceil(F.col("size") / cell)
    large = large.withColumn("block", F.pmod(F.xxhash64("sig"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    large = large.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("long").alias("side"), "sig", "n", "root", "sketch")
    large = large.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run_wide, "a long, b long")
    few = tk.parts(members.count(), 20_000)
    if nearest:
        return large.coalesce(few).distinct()
    small = by_token(members.where(F.col("size") <= wide).drop("size"), "root", "sig").mapInArrow(run_narrow, "a long, b long")
    return small.coalesce(few).unionByName(large.coalesce(few)).distinct()


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def with_roots(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists' members with their components; what has no link is its own."""
    return lists.select("token", "sig", "n").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("token", "sig", "n", F.coalesce("root", "sig").alias("root"))


def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """token, sig, n, root and size (members) of the lists that are shared by two components or more, as a table."""
    few = tk.parts(lists.count())
    members = with_roots(lists, roots).coalesce(few)
    shared = members.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 <> r1").select("token", "size")
    return tk.stored(members.join(shared, "token").select("token", "sig", "n", "root", "size").coalesce(few))
