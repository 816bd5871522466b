"""Exact Jaccard join of word shingle sets by T-occurrence search.

Equal sets are one class and only classes are compared. Two classes of n and m shingles are linked if they share at
least T = ceil(0.8 / 1.8 (n + m)). In any order of all shingles, two such sets share one of the first n - ceil(0.8 n) + 1
shingles of each, so only these enter the inverted lists, which a shuffle by shingle merges:

1. every member of a list meets the list's least member;
2. lists that are shared by more than `LONG` components are long: they come last in the order. Most are known before any
   list is shuffled, from one set in `SAMPLE`, which decides on the order alone; where others are found later, sets that had
   some in their prefix take further short lists in their place (`RENEWALS` times, as some of the new lists may be long too,
   and only if the long lists make many pairs for the entries that a renewal shuffles);
3. in lists of more than a few members each member meets its nearest one in another component, for as long as many members
   have one and that links many of them, in `NEAREST` of its lists, those of the least hash, so that near sets stand in the same ones; then, in all
   lists, all members meet that still are in different components. Each set has a parity sketch
   of two bits or more a shingle, an exact lower bound of the difference of two sets, so a dense group of sets that are
   just not alike makes few candidates, and whole sets are only fetched for pairs that can be links by their sketches. Lists of any length are cut into blocks, and pairs of blocks are separate tasks.

Entries carry their place in the order: two sets meet only if the shingle can be the first that they share. What meets is
searched by T-occurrence: for each probe and block of candidates, `search` makes the inverted lists of the probe's
shingles, divides off as many long lists as DivideSkip says, merges the short ones by a heap that skips what cannot reach
T, probes the long ones by binary search, and retains candidates with T occurrences.

No pair within a component needs to be met again, so a group of copies costs links in proportion to its size and no link
between different components is lost. The number of links of a document is not given: in a dense group it takes all pairs.

Shingles are 52 bits of a hash, and sets are told apart by 64 bits; results are exact as long as none of them collide.
Texts without words have an empty set, are linked with nothing and are their own component. A component's id is the least
doc_id in it; a null doc_id never is one unless its component has no other. Repeated rows repeat, an empty table gives
an empty one, other columns are not read. A very long text is one set of its own size.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.llm import textkit as tk
from opinara.llm.components import components, extended
from opinara.llm.lists import CELL, WIDE, crossing, mixed, shared_lists

K, PERCENT, LONG, RENEWALS, MOST_LONG, MOST_WANTED, LEAST_BITS, SKETCH_BITS, NEAREST, SPARSE, RENEWAL, SAMPLE = 5, 80, 64, 2, 1 << 20, 1 << 16, 512, 2, 4, 16, 4, 16
#: Candidates of one probe that are searched together, and the cost of a probe against a merge step.
BLOCK, MU = 256, 0.01


def sets(data: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and where each row begins."""
    n = len(at) - 1
    h, rows, _, _ = tk.words(data, at)
    s, of = tk.shingles(h, rows, k)
    first = tk.per_row(rows, n)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence is one shingle; its length is part of the hash
        own = [tk.shingles(h[first[i] : first[i + 1]] ^ np.uint64(counts[i]), rows[first[i] : first[i + 1]], counts[i])[0] for i in short]
        s, of = np.concatenate([s, *own]), np.concatenate([of, short])
    # row and hash in one number, so that one sort does for all rows; 52 bits of the hash remain
    both = np.sort((of.astype(np.uint64) << np.uint64(52)) | (s >> np.uint64(12)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both & np.uint64((1 << 52) - 1), tk.per_row((both >> np.uint64(52)).astype(np.int64), n)


def signature(s: np.ndarray) -> int:
    """A number for a whole set."""
    return int(tk.mix(np.array([np.bitwise_xor.reduce(tk.mix(s + np.uint64(len(s))))]))[0].view(np.int64))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of at least SKETCH_BITS times as many bits (a power of two)."""
    bits = max(LEAST_BITS, 1 << int(SKETCH_BITS * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 > 0, bitorder="little").tobytes()


def may_meet(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether a link's first common shingle can stand at these places. n and m are entries: size, and place << 32."""
    size_n, size_m = n & ((1 << 32) - 1), m & ((1 << 32) - 1)
    least = -(-(size_n + size_m) * percent // (100 + percent))
    return (size_n - (n >> 32) >= least) & (size_m - (m >> 32) >= least)


def _entries(rows: DataFrame) -> DataFrame:
    """token, sig and n (an entry of may_meet) of each shingle of the prefixes of distinct sets."""
    entry = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("n")).alias("n")
    return rows.select("sig", "n", F.posexplode("prefix").alias("place", "token")).select("sig", entry, "token")


def may_link(n, m, difference, percent: int = PERCENT):
    """For numbers or arrays of them: sizes, and a lower bound of the difference."""
    # J >= p means difference / (n + m) <= (1 - p) / (1 + p)
    return difference * (100 + percent) <= (100 - percent) * (n + m)


def search(probe: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Places of the candidates (sorted sets) that share as many shingles with the probe as a link needs, by DivideSkip."""
    n, m = len(probe), len(candidates)
    size = np.array([len(c) for c in candidates], np.int64)
    need = -(-(n + size) * percent // (100 + percent))
    held = np.concatenate(candidates)
    place = np.minimum(np.searchsorted(probe, held), n - 1)
    hit = probe[place] == held
    # the list of each shingle of the probe, one behind the other: place of the shingle * m + candidate
    entries = np.sort(place[hit] * m + np.repeat(np.arange(m), size)[hit])
    first = np.searchsorted(entries, np.arange(n + 1) * m)
    length = np.diff(first)
    least, longest = int(need.min()), int(length.max(initial=0))
    divided = min(least - 1, int(least / (MU * np.log2(max(longest, 1)) + 1)))
    order = np.argsort(-length, kind="stable")
    long, short = np.sort(order[:divided]), order[divided:]
    found = merge([(entries[first[p] : first[p + 1]] - p * m).tolist() for p in short.tolist() if length[p]], least - divided)
    out = []
    for c, count in found:
        probes = long * m + c
        at = np.minimum(np.searchsorted(entries, probes), len(entries) - 1)
        if count + int((entries[at] == probes).sum()) >= need[c]:
            out.append(c)
    return out


def merge(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(number, lists that hold it) of each number in at least `least` of the sorted lists, by a heap of their heads.
    Lists whose heads cannot reach `least` skip to the next head that can."""
    heap = [(x[0], i) for i, x in enumerate(lists)]
    at = [0] * len(lists)
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        head, popped = heap[0][0], []
        while heap and heap[0][0] == head:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            out.append((head, len(popped)))
            after = head + 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            after = max(head + 1, heap[0][0]) if heap else None
        for i in popped:
            at[i] = len(lists[i]) if after is None else bisect_left(lists[i], after, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))
    return out


def ordered(own: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A sorted set in an order in which the shingles that are late (booleans) come last."""
    return np.concatenate([own[~late], own[late]]) if late.any() else own


def _among(s: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which shingles are long; long is sorted."""
    return long[np.minimum(np.searchsorted(long, s), len(long) - 1)] == s if len(long) else np.zeros(len(s), bool)


def _often(docs: DataFrame, k: int, percent: int, long: int, sample: int) -> np.ndarray:
    """Shingles whose lists are likely to be long, sorted: those that long / sample or more sets (two at least) of one in `sample`
    distinct texts hold in thrice the prefix, which is as far as most sets have to look for others; at most MOST_LONG, the most
    frequent ones. They only decide on the order, in which every set is indexed: any order gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                s, at = sets(*tk.text_buffer(part.column("text")), k)
                own = [s[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]
                tokens = [x[: 3 * prefix_length(len(x), percent)].view(np.int64) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in own], pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["sig", "tokens"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(run, "sig long, tokens array<long>").dropDuplicates(["sig"])
    counts = tk.checkpointed(some.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= max(2, long // sample)))
    if counts.count() > MOST_LONG:
        counts = counts.orderBy(F.desc("count"), "token").limit(MOST_LONG)
    found = counts.select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def _prepare(docs: DataFrame, k: int, percent: int, late: np.ndarray, long: np.ndarray | None = None) -> DataFrame:
    """For each row: n, sig (of the set), prefix and sketch; late are sorted shingles that come last in the order. With long,
    more of them, only rows that have some in that prefix are given, without sketch: the prefix of all others is the same in both
    orders."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most MOST_LONG numbers each
    first, shared = docs.sparkSession.sparkContext.broadcast(late), None if long is None else docs.sparkSession.sparkContext.broadcast(long)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                s, at = sets(*tk.text_buffer(part.column("text")), k)
                keep, sigs, sizes, prefixes, sketches = [], [], [], [], []
                is_late = _among(s, first.value)
                is_long = None if shared is None else _among(s, shared.value)
                for i in range(part.num_rows):
                    own, last = s[at[i] : at[i + 1]], is_late[at[i] : at[i + 1]]
                    n, p = len(own), prefix_length(len(own), percent) if len(own) else 0
                    prefix = ordered(own, last)[:p]
                    if is_long is not None:
                        longs = is_long[at[i] : at[i + 1]]
                        if not ordered(longs, last)[:p].any():
                            continue
                        prefix = ordered(own, longs)[:p]
                    keep.append(i)
                    sizes.append(n)
                    sigs.append(signature(own) if n else None)
                    prefixes.append(prefix.view(np.int64))
                    sketches.append(sketch(own) if n and shared is None else None)
                ids = part.column("doc_id").take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n", "sig", "prefix", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, sig long, prefix array<long>, sketch binary")


def _without(prefixes: DataFrame, long: np.ndarray) -> DataFrame:
    """sig, n and prefix of the sets of whose prefix no shingle is long: those that _prepare leaves out."""
    shared = prefixes.sparkSession.sparkContext.broadcast(long)  # at most MOST_LONG numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("prefix")
            at, held = np.asarray(column.offsets), column.values.to_numpy()[: len(column.values)].view(np.uint64)
            found = np.r_[0, np.cumsum(_among(held, shared.value))]
            yield batch.filter(pa.array(found[at[1:]] == found[at[:-1]]))

    return prefixes.select("sig", "n", "prefix").mapInArrow(run, "sig long, n long, prefix array<long>")


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the difference of two sets by their sketches, of which the longer one is folded to the shorter one's size."""
    x, y = sorted((x, y), key=len)
    while len(y) > len(x):
        half = len(y) // 2
        y = (int.from_bytes(y[:half], "little") ^ int.from_bytes(y[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that can be links by their sketches; a table. Whole sets, many times as long, are only fetched for these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("n_a", "n_b", "s_a", "s_b")]
            yield batch.select(["a", "b"]).filter(pa.array([bool(may_link(n, m, apart(x, y), percent)) for n, m, x, y in zip(*c, strict=True)], pa.bool_()))

    few = tk.parts(pairs.count(), 20_000)
    for c in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c).coalesce(few)
    return tk.stored(pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long"))


def _whole(wanted: DataFrame, docs: DataFrame, classes: DataFrame, k: int, path: str) -> DataFrame | None:
    """sig and whole set of the classes with these sig, from one text of each, stored at path."""
    wanted = tk.checkpointed(wanted.select("sig").distinct())
    few = tk.parts(wanted.count())
    ids = tk.checkpointed(classes.join(wanted.coalesce(few), "sig", "left_semi").coalesce(few).groupBy("sig").agg(F.min("doc_id").alias("__id")).coalesce(few))
    count = ids.count()
    if not count:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                s, at = sets(*tk.text_buffer(part.column("text")), k)
                own = [s[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["sig", "whole"])

    # beyond that many rows a shuffle finds the texts
    texts = docs.join(F.broadcast(ids) if count <= MOST_WANTED else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return tk.stored(texts.select("text").mapInArrow(run, "sig long, whole binary").dropDuplicates(["sig"]).coalesce(tk.parts(count, 20_000)), path)


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that are links, by the full sets of one text of each class; a table."""
    path = tk.table_path(docs.sparkSession)
    few = tk.parts(pairs.count(), 20_000)
    pairs = pairs.coalesce(few)
    whole = _whole(pairs.select(F.explode(F.array("a", "b")).alias("sig")), docs, classes, k, path)
    if whole is None:
        return pairs

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, probe, names, block = None, None, [], []

        def links() -> pa.RecordBatch:
            good = search(probe, block, percent) if block else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(good), pa.int64()), pa.array([names[i] for i in good], pa.int64())], ["a", "b"])

        for batch in batches:
            for a, of, b, whole in zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b", "whole")), strict=True):
                if (a, of) != now or len(block) == BLOCK:
                    if block:
                        yield links()
                    names, block = [], []
                now = (a, of)
                if b is None:  # the probe comes first
                    probe = np.frombuffer(whole, np.uint64)
                else:
                    names.append(b)
                    block.append(np.frombuffer(whole, np.uint64))
        if block:
            yield links()

    # the candidates of a probe in blocks, each with the probe's set
    wide = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(wide, "a").coalesce(few).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    of_b = whole.select(F.col("sig").alias("b"), "whole")
    probes = dealt.select("a", "block").distinct().join(whole.withColumnRenamed("sig", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "whole")
    both = probes.coalesce(few).unionByName(dealt.join(of_b, "b").select("a", "block", "b", "whole").coalesce(few))
    links = tk.stored(both.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(check, "a long, b long").coalesce(few))
    tk.drop(docs.sparkSession, path)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, long: int = LONG, wide: int = WIDE, cell: int = CELL, renewal: float = RENEWAL, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    path = tk.table_path(spark)
    late = _often(docs, k, percent, long, sample)
    every = tk.stored(_prepare(docs, k, percent, late), path)
    rows = tk.stored(every.select("doc_id", "n", "sig"))  # without the prefixes, of which one a class is enough
    classes = rows.where("n > 0").select("sig", "doc_id")
    some = tk.parts(rows.count(), 5_000)
    of_prefixes, of_lists = tk.table_path(spark), tk.table_path(spark)
    prefixes = tk.stored(every.where("n > 0").select("sig", "n", "prefix", "sketch").dropDuplicates(["sig"]).coalesce(some), of_prefixes)
    tk.drop(spark, path)
    sketches = prefixes.select("sig", "n", "sketch")
    # entries of all lists, by the sizes of the sets
    total = prefixes.select(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    meets = lambda n, m: may_meet(n, m, percent)
    size = lambda n: n & ((1 << 32) - 1)
    may = lambda n, m, difference: may_link(size(n), size(m), difference, percent)
    lists = tk.stored(shared_lists(_entries(prefixes), meets).coalesce(some), of_lists)
    sizes = [F.col(c).bitwiseAND((1 << 32) - 1) for c in ("n", "lead_n")]
    least = F.ceil((sizes[0] + sizes[1]) * percent / (100 + percent))
    first = [z - F.shiftright(c, 32) >= least for z, c in zip(sizes, ("n", "lead_n"), strict=True)]
    # of the leads of its lists, a set first meets the one that leads most of them
    leads = lists.where((F.col("sig") != F.col("lead")) & first[0] & first[1]).groupBy("sig", "lead").count()
    few = tk.parts(lists.count())
    pairs = tk.checkpointed(leads.coalesce(few).groupBy("sig").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead")).select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b")).coalesce(few).distinct().coalesce(few))
    links = _verify(_possible(pairs, sketches, percent), docs, classes, k, percent)
    roots = tk.checkpointed(components(links))
    members = mixed(lists, roots)
    tk.drop(spark, of_lists)
    skipped = late
    for _ in range(RENEWALS):
        found, counts = _long_lists(members, long)
        new = ~np.isin(found, skipped)
        fresh = np.sort(found[new])
        if not len(fresh) or len(skipped) >= MOST_LONG or not worth(counts[new], int(total), renewal):
            break
        skipped = np.union1d(skipped, fresh[: max(0, MOST_LONG - len(skipped))])
        of_renewed, of_lists = tk.table_path(spark), tk.table_path(spark)
        renewed = tk.stored(_prepare(docs, k, percent, late, skipped).where("n > 0").select("sig", "n", "prefix").dropDuplicates(["sig"]).coalesce(some), of_renewed)
        lists = tk.stored(shared_lists(_entries(_without(prefixes, skipped).unionByName(renewed)), meets).coalesce(some), of_lists)
        tk.drop(spark, of_renewed)
        members = mixed(lists, roots)
        tk.drop(spark, of_lists)
    met = pairs
    dense = members.where(F.col("size") > wide)
    if not dense.isEmpty():
        near = mixed(_some_lists(dense), roots)
        while True:
            across = crossing(near, meets, may, sketches, True, 0, cell)
            across = tk.stored(across.coalesce(few).join(met, ["a", "b"], "left_anti").coalesce(few))
            more = _verify(across, docs, classes, k, percent)
            n_more, n_across = more.count(), across.count()
            met = met.unionByName(across)
            if not n_more:
                break
            roots = extended(roots, more)
            # most of what is near is not alike, or few members have a near one at all: the last round is due
            if 20 * n_more < n_across or SPARSE * n_across < near.count():
                break
            near = mixed(near, roots)
        members = mixed(members, roots)
    # the last round: all pairs meet
    across = crossing(members, meets, may, sketches, False, wide, cell)
    across = tk.stored(across.coalesce(few).join(met, ["a", "b"], "left_anti").coalesce(few))
    more = _verify(_possible(across, sketches, percent), docs, classes, k, percent)
    tk.drop(spark, of_prefixes)
    if not more.isEmpty():
        roots = extended(roots, more)
    # the least document of each class, then of each component; both combine before they shuffle
    of_class = classes.groupBy("sig").agg(F.min("doc_id").alias("least_id"))
    of_class = of_class.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    of_root = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of_class.join(of_root, "root").select("sig", "component_id")
    out = rows.select("doc_id", "n", "sig").join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _some_lists(members: DataFrame) -> DataFrame:
    """Of each member NEAREST of its lists at most, those of the least hash of their token."""
    by_hash = Window.partitionBy("sig").orderBy(F.xxhash64("token"), "token")
    return members.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= NEAREST).drop("rank")


def worth(counts: np.ndarray, entries: int, times: float = RENEWAL) -> bool:
    """Whether lists shared by so many components make so many more pairs than there are entries, all of which a renewal
    shuffles again; comparing two sketches costs far less than an entry. Lists that stay cost time, never links."""
    return float((counts.astype(float) ** 2).sum()) / 2 > times * entries


def _long_lists(members: DataFrame, long: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles whose lists are shared by more than `long` components, and by how many; at most MOST_LONG, the longest ones."""
    few = tk.parts(members.count())
    wide = members.coalesce(few).select("token", "root").distinct().coalesce(few).groupBy("token").count().where(F.col("count") > long).coalesce(few)
    found = wide.orderBy(F.desc("count"), "token").limit(MOST_LONG).toPandas()
    return found["token"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return join(tk.documents(spark, sf_dir))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, with all its columns: that with the least id, of several of them the one with
    the least hash of its text. Rows without an id come after all others, so they stay where no row of their component has one.
    Repeated rows become one; rows that share an id are told apart by their texts."""
    key, of = tk.unused(docs, "row_key", "of_row")
    own = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("without"), tk.row_key().alias("row")))
    found = tk.checkpointed(join(own, key).groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count("*").alias("copies")))
    # whole rows are only shuffled where rows repeat, or more go than a task should hold the keys of
    goes = tk.checkpointed(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(of)))
    more = tk.checkpointed(found.where((F.col("doc_id") == F.col("component_id")) & (F.col("copies") > 1)).select(F.col("doc_id").alias(of)))
    hinted = lambda keys: F.broadcast(keys) if keys.count() <= MOST_WANTED else keys
    among = F.col(key) == F.col(of)
    stays = own.join(hinted(goes), among, "left_anti")
    if not more.isEmpty():
        repeated = hinted(more)
        stays = stays.join(repeated, among, "left_anti").unionByName(stays.join(repeated, among, "left_semi").dropDuplicates([key]))
    return stays.select(*docs.columns)
