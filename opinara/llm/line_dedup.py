"""Fuzzy line deduplication.

A line is normalised to its terms: letters in lower case, digits all alike, other ASCII left out. Equal normalised lines
are one node. Nodes carry a SimHash of their distinct terms in `TABLES` blocks of `WIDTH` bits. By the pigeonhole
principle nodes that differ in fewer bits than there are blocks agree in a block; to find more, a node also stands in the
lists of a block with one of its `FLIPS` least decided bits turned, as these are the bits in which near lines differ. Of
nodes that share a list, those meet that differ in at most `CLOSE` of 64 bits outside the block. Beyond 2**28 nodes there
are more blocks, of more bits, as lists shared by chance grow with the square of the nodes.

First every member of a list meets the least one, verified links give components, and then only members of different
components meet. A pair is a link if the edit similarity of the normalised lines is `SIMILARITY` or more. Of each
connected group one occurrence stays: the least by (doc_id, line).

Characters of three or four bytes are terms of their own, so scripts without spaces have terms too. Lines of any length
take part, but with fewer than `FEW` distinct terms the bits of a SimHash on which they are undecided come from all of them
together. A line that has no term is its bytes without outer spaces, one of spaces only is never removed. A null text has
no lines, an empty table gives an empty one. Rows that share an id count as one document, and lines are kept or removed in
all of them alike; a null id sorts before all others. All other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opinara.llm import textkit as tk
from opinara.llm.components import components, extended
from opinara.llm.lists import crossing, mixed, shared_lists

LEAST, FEW, TABLES, WIDTH, FLIPS, CLOSE, SIMILARITY, MOST_WANTED, WIDE, DENSE, SEEN, SPARSE = 1, 5, 4, 24, 3, 12, 0.8, 1 << 16, 256, 16, 1 << 18, 16
BITS = TABLES * WIDTH


def blocks_for(lines: int) -> tuple[int, int]:
    """Blocks, and the bits of each: wider beyond 2**28 lines, so that lists shared by chance stay short, and then more
    of them, as wider blocks agree less often."""
    wider = max(0, max(1, lines).bit_length() - 28)
    return TABLES + wider, WIDTH + wider


def packed(sums: np.ndarray, count: np.ndarray, ties: np.ndarray, blocks: tuple[int, int]) -> np.ndarray:
    """Bytes of each line: its SimHash, and which bits of each block are the least decided. sums: how many of its count
    terms have each bit."""
    margin = np.abs(2 * sums.astype(np.int32) - count[:, None].astype(np.int32)).reshape(len(sums), *blocks)
    place = (np.minimum(margin, 500) * 64 + np.arange(blocks[1])).astype(np.int16)
    weakest = (np.partition(place, FLIPS - 1, axis=2)[:, :, :FLIPS] & 63).astype(np.uint8)
    return np.concatenate([np.packbits((2 * sums > count[:, None]) | ties, axis=1), weakest.reshape(len(sums), -1)], axis=1)


def addresses(code: np.ndarray, blocks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and checks of packed lines (lines x tables * (1 + FLIPS)). The check is the 64 bits that follow a block,
    round about."""
    tables, width = blocks
    n, size = len(code), tables * width
    bits, weakest = np.unpackbits(code[:, : -(-size // 8)], axis=1)[:, :size], code[:, -(-size // 8) :].reshape(n, tables, FLIPS)
    place = np.int64(1) << np.arange(width, dtype=np.int64)
    own = bits.reshape(n, tables, width) @ place
    tokens = np.concatenate([own[:, :, None], own[:, :, None] ^ place[weakest]], axis=2) | (np.arange(tables, dtype=np.int64) << width)[None, :, None]
    at = (width * (1 + np.arange(tables))[:, None] + np.arange(64)) % size
    checks = np.packbits(bits[:, at], axis=2).view(np.int64)
    return tokens.reshape(n, -1), np.repeat(checks, 1 + FLIPS, axis=2).reshape(n, -1)


#: For each byte a number whose bytes are the byte's bits, so that adding numbers counts bits.
_APART = np.array([sum((v >> (7 - i) & 1) << 8 * i for i in range(8)) for v in range(256)], np.uint64)


def bit_sums(term: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """How many terms of each line have each bit of `width` hashed ones. Terms are added 255 at a time, so that a byte holds
    the count."""
    size = -(-width // 8)
    raw = np.concatenate([tk.mix(term + np.uint64(i << 41)).view(np.uint8).reshape(-1, 8) for i in range(-(-width // 64))], axis=1)[:, :size]
    starts = first if count.max(initial=0) <= 255 else np.concatenate([np.arange(a, a + n, 255) for a, n in zip(first.tolist(), count.tolist(), strict=True)])
    some = np.add.reduceat(_APART[raw], starts, axis=0).view(np.uint8).reshape(len(starts), -1)[:, :width]
    return some.astype(np.int32) if starts is first else np.add.reduceat(some, np.searchsorted(starts, first), axis=0, dtype=np.int32)


def bare_lines(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Row, number, key, first and last byte of lines without terms that are not only spaces."""
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.r_[at[:-1], breaks + 1])
    begin = begin[begin < len(data)]
    held = np.searchsorted(starts, np.r_[begin, len(data)])
    out = []
    for i in np.flatnonzero(held[1:] == held[:-1]).tolist():
        a = int(begin[i])
        line = data[a : int(begin[i + 1]) if i + 1 < len(begin) else len(data)].tobytes()
        inner = line.strip(tk.SEPARATORS)
        if not inner:
            continue
        a += line.index(inner)
        row = int(np.searchsorted(at, a, "right")) - 1
        key = int.from_bytes(hashlib.blake2b(inner, digest_size=8).digest(), "little", signed=True)
        out.append((row, int(np.searchsorted(breaks, a) - np.searchsorted(breaks, at[row])), key, a, a + len(inner)))
    return out


def unseen(key: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that are not among the sorted seen ones, and where each stands first."""
    keys, first = np.unique(key, return_index=True)
    new = seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] != keys if len(seen) else np.ones(len(keys), bool)
    return keys[new], first[new]


def lines_of(data: np.ndarray, at: np.ndarray, least: int = LEAST, blocks: tuple[int, int] | None = None, seen: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Row, number, key, first and last byte of each line that has enough terms; for least = 1 also of lines of other
    signs. With blocks also the packed codes of lines that have terms, and which lines these are; with seen, sorted keys,
    only the first line of each other key has one."""
    h, rows, starts, ends = tk.words(data, at, sep=tk.TERM_SEP, codes=tk.FOLDED, unspaced=True)
    bare = np.array(bare_lines(data, at, starts) if least <= 1 else [], np.int64).reshape(-1, 5).T
    broken = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int32)])
    number = broken[starts] - broken[at[rows]]
    fresh = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[fresh, len(h)])
    names = ("row", "number", "key", "begin", "end")
    if not len(fresh):
        return dict(zip(names, bare, strict=True)) | {"code": np.zeros((0, 1), np.uint8), "coded": np.zeros(0, np.int64)}
    place = np.arange(len(h)) - np.repeat(fresh, size)
    key = tk.mix(np.add.reduceat(tk.mix(h ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), fresh) + size.astype(np.uint64))
    enough = np.flatnonzero(size >= least)
    last = np.r_[fresh[1:], len(h)] - 1
    own = dict(zip(names, (rows[fresh], number[fresh], key.view(np.int64), starts[fresh], ends[last]), strict=True))
    out = {k: np.r_[own[k][enough], o] for k, o in zip(names, bare, strict=True)}
    if blocks is None:
        return out
    width = blocks[0] * blocks[1]
    coded = np.arange(len(enough)) if seen is None else np.sort(unseen(key.view(np.int64)[enough], seen)[1])
    size, fresh = size[enough][coded], fresh[enough][coded]
    # each term of a line counts once, or its most common terms alone would decide the bits
    line = np.repeat(np.arange(len(fresh)), size)
    own = h[np.arange(len(line)) + np.repeat(fresh - np.cumsum(size) + size, size)]
    both = np.sort((line.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    line, term = (both >> np.uint64(40)).astype(np.int64), both & np.uint64((1 << 40) - 1)
    first = tk.per_row(line, len(fresh))
    code = [np.zeros((0, -(-width // 8) + FLIPS * blocks[0]), np.uint8)]
    step = 1 << 10  # lines at a time
    for i in range(0, len(fresh), step):
        edges = first[i : i + step + 1]
        starts_at, own = edges[:-1] - edges[0], term[edges[0] : edges[-1]]
        count = np.diff(edges)
        sums = bit_sums(own, starts_at, count, width)
        ties = np.zeros(sums.shape, bool)
        few = np.flatnonzero(count < FEW)
        if len(few):  # ties as zeros would make short lines alike
            together = np.add.reduceat(tk.mix(own), starts_at)[few] & np.uint64((1 << 40) - 1)
            ties[few] = (2 * sums[few] == count[few, None]) & (bit_sums(together, np.arange(len(few)), np.ones(len(few), np.int64), width) > 0)
        code.append(packed(sums, count, ties, blocks))
    return out | {"code": np.concatenate(code), "coded": coded}


def normal(line: bytes) -> str:
    """The terms of a line as one text, or the line itself if it has none."""
    folded = tk.folded(tk.fold_letters(np.frombuffer(line, np.uint8)))
    folded[tk.TERM_SEP[folded]] = 32
    return (b" ".join(folded.tobytes().split()) or line.strip(tk.SEPARATORS)).decode("utf-8", "replace")


def alike(a, b) -> int:
    """How many first places of a and b, of which a is the shorter one, are the same."""
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def distance(a, b, most: int) -> int:
    """Edit distance of two texts or lists of words, bit-parallel over one column at a time; most + 1 where it is greater."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    same = alike(a, b)
    a, b = a[same:], b[same:]
    same = alike(a[::-1], b[::-1])
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or len(b) - len(a) > most:
        return min(len(b), most + 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, d = full, 0, len(a)
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        d += bool(ph & top) - bool(mh & top)
        if d - (len(b) - j - 1) > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return d


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    v, w = a.split(), b.split()
    if len(v) > 8:
        # changing d words changes no more characters than the d longest have, with a space each
        d = distance(v, w, len(v) // 4)
        if d <= len(v) // 4 and sum(sorted(map(len, v + w))[-d:] if d else ()) + d <= most:
            return True
    return distance(a, b, most) <= most


def occurrences(docs: DataFrame, least: int = LEAST, blocks: tuple[int, int] = (TABLES, WIDTH), counted: bool = False) -> DataFrame:
    """doc_id, number, key of every line with enough terms, and the code once in a while for each key: a task keeps `SEEN` keys in
    mind, whose codes it has given. counted: a row without a key stands for each text, with the number of all its lines, 0 if it is null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for part in tk.slices(batch, "text"):
                data, at = tk.text_buffer(part.column("text"))
                f = lines_of(data, at, least, blocks, seen)
                new = np.sort(f["key"][f["coded"]])
                seen = np.insert(seen, np.searchsorted(seen, new), new) if len(seen) < SEEN else new
                raw, size = f["code"].tobytes(), f["code"].shape[1]
                of = np.full(len(f["row"]), -1)
                of[f["coded"]] = np.arange(len(new))
                code = pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()).take(pa.array(of, mask=of < 0))
                names = ["doc_id", "number", "key", "code"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(f["row"])), *(pa.array(f[c], pa.int64()) for c in ("number", "key")), code], names)
                if counted:
                    n_lines = np.where(np.asarray(part.column("text").is_null()), 0, 1 + np.diff(np.searchsorted(np.flatnonzero(data == 10), at)))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_lines, pa.int64()), pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.binary())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, number long, key long, code binary")


def entries(nodes: DataFrame, blocks: tuple[int, int]) -> DataFrame:
    """token, sig (the key) and n (the check) of each node that has terms."""
    n = blocks[0] * (1 + FLIPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_pylist()
            if code:
                tokens, checks = addresses(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel()), pa.array(np.repeat(batch.column("key").to_numpy(), n)), pa.array(checks.ravel())], ["token", "sig", "n"])

    return nodes.where("code IS NOT NULL").select("key", "code").mapInArrow(run, "token long, sig long, n long")


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose normalised lines are similar. The text of a line comes from its first occurrence."""
    few = tk.parts(pairs.count(), 20_000)
    pairs = pairs.coalesce(few)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().coalesce(few)
    # at most the lines of one text
    places = tk.checkpointed(nodes.join(wanted, "key", "left_semi").coalesce(few).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("key").alias("keys")).coalesce(few))
    count = places.count()
    if not count:
        return pairs
    # beyond that many rows a shuffle finds the texts
    some = docs.join(F.broadcast(places) if count <= MOST_WANTED else places, F.col("doc_id").eqNullSafe(F.col("__id"))).select("keys", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                data, at = tk.text_buffer(part.column("text"))
                f = lines_of(data, at, 1)
                asked = part.column("keys")
                first = np.asarray(asked.offsets)
                both = np.stack([np.repeat(np.arange(part.num_rows), np.diff(first)), np.asarray(asked.values)[first[0] : first[-1]]])
                pairs = set(map(tuple, both.T.tolist()))
                own = [i for i, x in enumerate(zip(f["row"].tolist(), f["key"].tolist(), strict=True)) if x in pairs]
                lines = [normal(data[f["begin"][i] : f["end"][i]].tobytes()) for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(f["key"][own] if own else [], pa.int64()), pa.array(lines, pa.string())], ["key", "line"])

    lines = tk.stored(some.mapInArrow(extract, "key long, line string").groupBy("key").agg(F.min("line").alias("line")).coalesce(few))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([similar(x, y, similarity) for x, y in zip(batch.column("l_a").to_pylist(), batch.column("l_b").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    for c in ("a", "b"):
        pairs = pairs.join(lines.select(F.col("key").alias(c), F.col("line").alias(f"l_{c}")), c).coalesce(few)
    return pairs.select("a", "b", "l_a", "l_b").mapInArrow(check, "a long, b long")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least: int = LEAST, blocks: tuple[int, int] | None = None) -> DataFrame:
    """doc_id and number of each line that goes; rows that share an id are taken for one text, so `dedup` gives a key of id and
    text. blocks: of the SimHash and their bits, or such as fit sixteen lines a row."""
    return _removed(docs, id_col, text_col, similarity, least, blocks)[0]


def _removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least: int = LEAST, blocks: tuple[int, int] | None = None, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """What removed() gives, and if counted doc_id and n_lines of each row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = blocks or blocks_for(16 * docs.count())
    found = tk.stored(occurrences(texts, least, blocks, counted))
    n_lines = found.where("key IS NULL").select("doc_id", F.col("number").alias("n_lines"))
    found = found.where("key IS NOT NULL")
    some = tk.parts(found.count(), 50_000)
    nodes = found.groupBy("key").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.min("code").alias("code"), F.count("*").alias("copies"))
    nodes = tk.stored(nodes.select("key", "code", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.number").alias("number")).coalesce(some))
    # viewed as unsigned, as bitwise_count takes the absolute value of signed numbers
    gap = lambda n, m: np.bitwise_count((n ^ m).view(np.uint64)).astype(np.int64)
    meets = lambda n, m: gap(n, m) <= CLOSE
    lists = tk.stored(shared_lists(entries(nodes, blocks), meets, WIDE).coalesce(some), narrow=True)
    far = F.bit_count(F.col("n").bitwiseXOR(F.col("lead_n")))
    leads = lists.where((F.col("sig") != F.col("lead")) & (far <= CLOSE)).groupBy("sig", "lead").agg(F.count("*").alias("n"), F.min(far).alias("far"))
    # of the leads of its lists, a node first meets the one that leads most of them
    few = tk.parts(lists.count())
    pairs = leads.coalesce(few).groupBy("sig").agg(F.max_by("lead", F.struct("n", -F.col("far"), "lead")).alias("lead")).select(F.least("sig", "lead").alias("a"), F.greatest("sig", "lead").alias("b"))
    met = tk.checkpointed(pairs.coalesce(few).distinct().coalesce(few))
    links = tk.checkpointed(_verify(met, docs, nodes, similarity))
    roots = tk.checkpointed(components(links))
    members = mixed(lists, roots)
    for nearest in (False,) if members.where(F.col("size") > DENSE).isEmpty() else (True, False):
        while True:
            across = crossing(members, meets, nearest=nearest, wide=DENSE, gap=gap)
            across = tk.checkpointed(across.coalesce(few).join(met, ["a", "b"], "left_anti").coalesce(few))
            more = tk.checkpointed(_verify(across, docs, nodes, similarity))
            n_more, n_across = more.count(), across.count()
            met = met.unionByName(across)
            if not n_more:
                break
            roots = extended(roots, more)
            if not nearest:  # all pairs have met
                break
            # most of what is near is not alike, or few members have a near one at all: the last round is due
            due = 20 * n_more < n_across or SPARSE * n_across < members.where(F.col("size") > DENSE).count()
            members = mixed(members, roots)
            if due:
                break
    roots = roots.withColumnRenamed("node", "key")
    # the occurrence that stays, for nodes that have another occurrence or a link
    nodes = nodes.drop("code")
    linked = nodes.join(roots, "key")
    stays = linked.groupBy("root").agg(F.min(F.struct("doc_id", "number")).alias("stay"))
    of_node = linked.select("key", "root").join(stays, "root").select("key", "stay")
    alone = nodes.where("copies > 1").join(roots, "key", "left_anti").select("key", F.struct("doc_id", "number").alias("stay"))
    decided = of_node.unionByName(alone)
    gone = found.select("doc_id", "number", "key").join(decided, "key").where(~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("number") == F.col("stay.number"))))
    return gone.select("doc_id", "number").distinct(), n_lines


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated lines taken out of the text; all columns stay, and n_chars follows the text if there is one.
    Rows of which no word is left go, unless they had none before."""
    of, lines, key = tk.unused(docs, "of_doc", "gone_lines", "row_key")
    docs_columns = docs.columns
    docs = docs.withColumn(key, tk.shortest_key(docs, id_col, text_col))
    gone = removed(docs, key, text_col, **options).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set("number").alias(lines))  # at most the lines of one text
    joined = docs.join(gone, F.col(key) == F.col(of), "left")
    kept = F.expr(f"filter(split(`{text_col}`, '\\n'), (line, i) -> NOT array_contains(`{lines}`, cast(i AS bigint)))")
    untouched = F.col(lines).isNull()
    joined = joined.withColumn(text_col, F.when(untouched, F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    joined = joined.where(untouched | F.col(text_col).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.char_length(text_col).cast(docs.schema["n_chars"].dataType)))
    return joined.select(*docs_columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many of its lines go, and which."""
    docs = tk.documents(spark, sf_dir)
    docs = docs.withColumn("row_key", tk.shortest_key(docs))
    gone, counted = _removed(docs, "row_key", counted=True)
    gone = gone.groupBy(F.col("doc_id").alias("of_row")).agg(F.array_sort(F.collect_set("number")).alias("removed_lines"))
    # lines were counted when they were read, so texts are not read once more
    of_id = F.col("row_key.id") if isinstance(docs.schema["row_key"].dataType, StructType) else F.col("row_key")
    out = counted.select(F.col("doc_id").alias("row_key"), "n_lines").join(gone, F.col("row_key") == F.col("of_row"), "left").select(of_id.alias("doc_id"), "n_lines", "removed_lines")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed_lines", ","), F.lit("")).alias("removed_lines"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines."""
    return dedup(docs)
