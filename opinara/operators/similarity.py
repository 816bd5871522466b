"""Exact neighbours by cosine similarity, comparing no more pairs than must be.

Vectors of unit length are compared by their distance, which orders them as the cosine does. The right side is cut into
blocks around pivots, each with its radius. By the triangle inequality only blocks whose pivot is no farther than a row's
k-th distance so far plus their radius can hold anything nearer, so the row asks for those alone.

Blocks are put together into cells of about `1 / CELLS` of the rows, but no more than `CELL_BYTES` of vectors. A table that is
compared with itself first meets itself cell by cell, which gives each row its k-th distance so far; then each two cells of which
one holds a row that asks for the other meet in a task of their own, which multiplies each two rows once, for both. With two
tables a left row first meets the block of its nearest pivot, and then goes once to each cell that has a block it asks for.
So a row is copied `CELLS` times at most, and only beyond CELLS * CELL_BYTES of vectors more often.

Products of float32 choose what is looked at; their error is bounded, and what they let pass is computed again in float64. In
data without clusters the products remain those of all pairs (half of them, where a table meets itself), but what is shuffled and
kept does not. A task keeps k rows for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.graph import settled

#: Rows of a side in one task, and the most pivots; they go to every task, MOST_PIVOTS vectors at most.
BLOCK_ROWS, MOST_PIVOTS = 4096, 4096
#: Cells of a table, and the bytes of the vectors of one; fewer than LEAST_CELL rows are not parted.
CELLS, CELL_BYTES, LEAST_CELL = 8, 32 << 20, 2048
#: Distances are taken as equal within this, so that rounding never prunes a neighbour; similarities are rounded to DIGITS.
SLACK, DIGITS = 1e-6, 9
#: Rows of either side that are multiplied at once. Similarities are compared as whole units of the last digit below 1.
TILE, UNITS = (512, 1024), 10**DIGITS


def _kept(df: DataFrame) -> DataFrame:
    """Computed once: checkpointed where the session has a folder for that, else persisted."""
    done = settled(df)
    return df.persist() if done is df else done


def unit(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v of unit length; null vectors, those of length zero and those with a null or a number
    that is not finite have no direction and are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), norm.alias("norm")).where("norm > 0 AND norm < double('Infinity')")
    # as an element the norm is bound once a row; as a column it would be put in place, and computed, for each x
    return rows.select("id", F.element_at(F.transform(F.array("norm"), lambda n: F.transform("v", lambda x: x / n)), 1).alias("v"))


def pivots_of(rows: DataFrame, n: int, block_rows: int) -> np.ndarray:
    """Vectors with the least hash of their id, one for each block."""
    count = min(MOST_PIVOTS, max(1, -(-n // block_rows)))
    return np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(count).collect()])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A row for each vector."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.zeros(0), *(x.flatten().to_numpy() for x in chunks)]).reshape(len(column), width)


def _nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds block and off, the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if (pc.list_value_length(b["v"]).to_numpy() != pivots.shape[1]).any():
                raise ValueError("vectors are of different lengths")
            v, block, off = _matrix(b["v"], pivots.shape[1]), np.zeros(len(b), "int32"), np.zeros(len(b))
            for i in range(0, len(v), 512):
                s = v[i : i + 512] @ pivots.T
                best = s.argmax(1)
                block[i : i + 512], off[i : i + 512] = best, np.sqrt(np.maximum(2 - 2 * s[np.arange(len(s)), best], 0))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(block), pa.array(off)], ["id", "v", "block", "off"])

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, block int, off double")


def _wanted(rows: DataFrame, pivots: np.ndarray, blocks: np.ndarray, radii: np.ndarray, cells: tuple[np.ndarray, np.ndarray] | None = None, only: list[str] | None = None) -> DataFrame:
    """rows: id, v, block (met already), reach (k-th distance so far). A row for each other block that may hold nearer
    ones; with cells, places of blocks and the sorted cell of each, for each cell of such blocks, with all columns or only some."""
    place, cell = cells or (np.arange(len(blocks)), blocks)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    kept = rows if cells else rows.select("id", "v", "block", "reach")
    names = only or kept.columns
    schema = kept.select(*names).withColumn("cell", F.lit(0)).schema if cells else kept.select("id", "v", "block").schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 256):
                part = f.iloc[i : i + 256]
                d = distances(np.stack(part["v"].to_numpy()), pivots[blocks])
                near = d - radii <= part["reach"].to_numpy()[:, None] + SLACK
                near &= blocks != part["block"].to_numpy()[:, None]
                row, c = np.nonzero(np.logical_or.reduceat(near[:, place], first, axis=1))
                c = cell[first][c].astype("int32")
                yield part[names].iloc[row].assign(cell=c) if cells else part.iloc[row][["id", "v"]].assign(block=c)

    return kept.mapInPandas(run, schema)


def _packed(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each block: neighbours in the order share a cell of at most `most` rows, a block of
    more rows has cells of its own."""
    first, parts, cell, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[i], parts[i] = cell, max(1, -(-n // most))
        cell, held = (cell + int(parts[i]), 0) if n > most else (cell, held + n)
    return first, parts


class _Cell:
    """Rows of a cell in the order of their blocks: ids and their order, vectors in both precisions, the place of each row's block
    among those of the cell, where these begin, and the most units below 1 that count so far."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        rows = rows.take(np.argsort(rows["block"].to_numpy(), kind="stable"))
        self.ids, self.v = rows["id"].combine_chunks(), _matrix(rows["v"], width)
        self.f = self.v.astype(np.float32)
        self.blocks, self.block = np.unique(rows["block"].to_numpy(), return_inverse=True)
        self.cuts = np.searchsorted(self.block, np.arange(len(self.blocks) + 1))
        self.by_rank = np.argsort(rows["id"].to_pandas().rank(method="first").to_numpy())  # ids may be of any type; equal similarities go by them
        self.rank = np.empty_like(self.by_rank)
        self.rank[self.by_rank] = np.arange(len(rows))
        worst = rows["worst"].to_numpy().astype(float) if "worst" in rows.column_names else np.full(len(rows), np.nan)
        self.most = np.where(np.isnan(worst), 4 * UNITS, UNITS - np.rint(np.nan_to_num(worst) * UNITS)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.v)

    def wants(self, most: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """Which blocks may hold what counts for a row."""
        reach = np.where(most > 2 * UNITS, np.inf, np.sqrt(2 * (most + 1) / UNITS))
        return np.concatenate([np.zeros((0, len(radii)), bool), *(distances(self.v[i : i + 1024], pivots) - radii <= reach[i : i + 1024, None] + SLACK for i in range(0, len(self), 1024))])


class _Found:
    """The best k of other rows for each row. What float32 lets pass is offered; similarities of float64 decide what stays. The
    same may be offered twice. With codes of the ids of both, rows of one id are no neighbours."""

    def __init__(self, rows: _Cell, others: _Cell, k: int, codes: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.rows, self.others, self.k, self.most, self.codes = rows, others, k, rows.most.copy(), codes
        self.most_of_id = int(np.bincount(codes[1]).max(initial=0)) if codes else 0
        self.row, self.off, self.rank, self.offered, self.held = *(np.zeros(0, np.int64) for _ in range(3)), [], 0
        self.settle()

    def offer(self, row: np.ndarray, at: np.ndarray) -> None:
        if self.codes:
            other = self.codes[0][row] != self.codes[1][at]
            row, at = row[other], at[other]
        self.offered.append((row, at))
        self.held += len(row)
        if self.held > max(1 << 18, 2 * self.k * len(self.rows)):
            self.settle()

    def settle(self) -> None:
        if self.offered:
            row, at = (np.concatenate(x) for x in zip(*self.offered, strict=True))
            self.offered, self.held, off = [], 0, np.zeros(len(row), np.int64)
            for i in range(0, len(row), 8192):
                s = np.einsum("ij,ij->i", self.rows.v[row[i : i + 8192]], self.others.v[at[i : i + 8192]])
                off[i : i + 8192] = np.maximum(UNITS - np.rint(s * UNITS), 0)
            good = off <= self.most[row]
            self._sort(np.r_[self.row, row[good]], np.r_[self.off, off[good]], np.r_[self.rank, self.others.rank[at[good]]])
        # of n products and sums in float32, each of which errs by 2^-24 at most
        self.bar = ((UNITS - self.most) / UNITS - 1 / UNITS - (self.rows.v.shape[1] + 8) * 2.0**-24).astype(np.float32)

    def _sort(self, row: np.ndarray, off: np.ndarray, rank: np.ndarray) -> None:
        bits = max(len(self.others) - 1, 1).bit_length()
        if max(len(self.rows) - 1, 1).bit_length() + 31 + bits <= 63:  # a number each
            key = np.sort(row << (31 + bits) | off << bits | rank)
            row, off, rank = key >> (31 + bits), key >> bits & (1 << 31) - 1, key & (1 << bits) - 1
        else:
            order = np.lexsort((rank, off, row))
            row, off, rank = row[order], off[order], rank[order]
        if len(row):
            new = np.r_[True, (row[1:] != row[:-1]) | (rank[1:] != rank[:-1])]
            row, off, rank = row[new], off[new], rank[new]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            self.most[row[place == self.k - 1]] = off[place == self.k - 1]
            row, off, rank = row[place < self.k], off[place < self.k], rank[place < self.k]
        self.row, self.off, self.rank = row, off, rank

    def crowded(self, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Where much passes, as among copies, only the best k of a tile are offered."""
        hit = s >= self.bar[i][:, None]
        many = hit.sum(1) > 4 * self.k
        r, c = np.nonzero(hit & ~many[:, None])
        self.offer(i[r], j[c])
        j, i = j[np.argsort(self.others.rank[j])], i[many]
        if len(i):
            off = UNITS - np.rint(self.rows.v[i] @ self.others.v[j].T * UNITS).astype(np.int64)
            key = np.maximum(off, 0) << 20 | np.arange(len(j))
            most = self.k + self.most_of_id
            best = (np.partition(key, most, axis=1)[:, :most] if len(j) > most else key) & (1 << 20) - 1
            self.offer(np.repeat(i, best.shape[1]), j[best].ravel())

    def lists(self) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Rows with any, and for each the ids and the units below 1."""
        self.settle()
        row, first = np.unique(self.row, return_index=True)
        offsets = pa.array(np.r_[first, len(self.row)].astype("int32"))
        return row, pa.ListArray.from_arrays(offsets, self.others.ids.take(pa.array(self.others.by_rank[self.rank]))), pa.ListArray.from_arrays(offsets, pa.array(self.off))


def _tile(a: _Cell, i: np.ndarray, b: _Cell, j: np.ndarray, to_a: _Found, to_b: _Found | None) -> None:
    s = a.f[i] @ b.f[j].T
    low = min(to_a.bar[i].min(), np.inf if to_b is None else to_b.bar[j].min())
    hit = (s >= low).ravel()
    whole = len(hit) & ~7
    eight = np.flatnonzero(hit[:whole].view(np.uint64) != 0)
    if len(eight) > len(hit) // 128:
        to_a.crowded(s, i, j)
        if to_b is not None:
            to_b.crowded(np.ascontiguousarray(s.T), j, i)
        return
    at = (eight[:, None] * 8 + np.arange(8)).ravel()
    at = np.r_[at[hit[at]], whole + np.flatnonzero(hit[whole:])]
    if len(at):
        s, r, c = s.ravel()[at], i[at // len(j)], j[at % len(j)]
        good = s >= to_a.bar[r]
        to_a.offer(r[good], c[good])
        if to_b is not None:
            good = s >= to_b.bar[c]
            to_b.offer(c[good], r[good])


def _cross(a: _Cell, b: _Cell, want_a: np.ndarray, want_b: np.ndarray | None, to_a: _Found, to_b: _Found | None) -> None:
    """Whole tiles where most of them is asked for, on either side, else rows that ask, block by block."""

    def asked(x: _Cell, want: np.ndarray, i: np.ndarray, y: _Cell, j: np.ndarray, to: _Found) -> None:
        for p in np.flatnonzero(want.any(0)) + y.block[j[0]]:
            _tile(x, i[want[:, p - y.block[j[0]]]], y, np.arange(max(j[0], y.cuts[p]), min(j[-1] + 1, y.cuts[p + 1])), to, None)

    for lo in range(0, len(a), TILE[0]):
        i = np.arange(lo, min(lo + TILE[0], len(a)))
        for at in range(lo if a is b else 0, len(b), TILE[1]):
            j = np.arange(at, min(at + TILE[1], len(b)))
            x = want_a[i[0] : i[-1] + 1, b.block[j[0]] : b.block[j[-1]] + 1]
            y = np.zeros((1, 1), bool) if want_b is None else want_b[j[0] : j[-1] + 1, a.block[i[0]] : a.block[i[-1]] + 1]
            if x.mean() + y.mean() > 0.6:
                _tile(a, i, b, j, to_a, to_b)
            else:
                asked(a, x, i, b, j, to_a)
                if to_b is not None:
                    asked(b, y, j, a, i, to_b)


def _codes(x: _Cell, y: _Cell) -> tuple[np.ndarray, np.ndarray]:
    """Equal for equal ids."""
    code = pd.factorize(pd.concat([x.ids.to_pandas(), y.ids.to_pandas()], ignore_index=True))[0]
    return code[: len(x)], code[len(x) :]


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    held: dict[int, list[pa.Table]] = {}
    for b in batches:
        t = pa.Table.from_batches([b])
        keys = pc.unique(t[key]).to_pylist()
        for x in keys:
            held.setdefault(x, []).append(t.filter(pc.equal(t[key], x)) if len(keys) > 1 else t)
    for x in list(held):
        yield x, pa.concat_tables(held.pop(x))


def _own_cells(placed: DataFrame, k: int, pivots: np.ndarray, blocks: np.ndarray, radii: np.ndarray, n: int) -> DataFrame:
    """placed: id, v, block, cell (of n). Adds ids and off of the best k of the cell, and worst and reach where there are k."""
    kind = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _by_key(batches, "cell"):
            x = _Cell(rows, pivots.shape[1])
            del rows
            found, place = _Found(x, x, k, _codes(x, x)), np.searchsorted(blocks, x.blocks)
            for lo, hi in zip(x.cuts[:-1].tolist(), x.cuts[1:].tolist(), strict=True):
                for i in range(lo, hi, TILE[0]):
                    for j in range(lo, hi, TILE[1]):
                        _tile(x, np.arange(i, min(i + TILE[0], hi)), x, np.arange(j, min(j + TILE[1], hi)), found, None)
            found.settle()
            want = x.wants(found.most, pivots[blocks[place]], radii[place])
            _cross(x, x, want, want, found, found)
            row, ids, off = found.lists()
            full = found.most <= 2 * UNITS
            worst = pa.array((UNITS - found.most) / UNITS, mask=~full)
            reach = pa.array(np.where(full, np.sqrt(2 * (found.most + 1) / UNITS), np.inf))
            at = np.full(len(x), -1)
            at[row] = np.arange(len(row))
            take = pa.array(at, mask=at < 0)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * x.v.shape[1]), pa.array(x.v.ravel()))
            block, cells = pa.array(x.blocks[x.block].astype("int32")), pa.array(np.full(len(x), cell, "int32"))
            yield from pa.table([x.ids, v, block, cells, ids.take(take), off.take(take), worst, reach], names).to_batches(4096)

    names = ["id", "v", "block", "cell", "ids", "off", "worst", "reach"]
    return placed.select("id", "v", "block", "cell").repartitionById(n, F.col("cell")).mapInArrow(run, f"id {kind}, v array<double>, block int, cell int, ids array<{kind}>, off array<bigint>, worst double, reach double")


def _between_cells(own: DataFrame, pairs: list[tuple[int, int]], k: int, pivots: np.ndarray, blocks: np.ndarray, radii: np.ndarray) -> DataFrame:
    """left_id, ids and off: for each two cells that meet, and each row of either, the best k of the other that are not farther
    than its worst so far."""
    kind = own.schema["id"].dataType.simpleString()
    meets = own.sparkSession.createDataFrame([(c, p) for p, two in enumerate(pairs) for c in two], "cell int, pair int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair, rows in _by_key(batches, "pair"):
            x, y = (_Cell(rows.filter(pc.equal(rows["cell"], c)), pivots.shape[1]) for c in pairs[pair])
            del rows
            codes = _codes(x, y)
            to_x, to_y = _Found(x, y, k, codes), _Found(y, x, k, codes[::-1])
            in_x, in_y = np.searchsorted(blocks, x.blocks), np.searchsorted(blocks, y.blocks)
            _cross(x, y, x.wants(x.most, pivots[blocks[in_y]], radii[in_y]), y.wants(y.most, pivots[blocks[in_x]], radii[in_x]), to_x, to_y)
            for side, to in ((x, to_x), (y, to_y)):
                row, ids, off = to.lists()
                yield from pa.table([side.ids.take(pa.array(row)), ids, off], ["left_id", "ids", "off"]).to_batches(4096)

    dealt = own.select("id", "v", "block", "cell", "worst").join(F.broadcast(meets), "cell").repartitionById(len(pairs), F.col("pair"))
    return dealt.mapInArrow(run, f"left_id {kind}, ids array<{kind}>, off array<bigint>")


def _in_cells(asks: DataFrame, right: DataFrame, k: int, pivots: np.ndarray, blocks: np.ndarray, radii: np.ndarray, lefts: int) -> DataFrame:
    """left_id, ids and off: of each row of asks (id, v, block, worst, cell) the best k of the blocks of the cell that it asks
    for, which are not farther than its worst so far. right: id, v, block, cell. lefts: parts of asks."""
    left_kind, kind = (x.schema["id"].dataType.simpleString() for x in (asks, right))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _Cell(a, pivots.shape[1]), _Cell(b, pivots.shape[1])
        to, place = _Found(x, y, k), np.searchsorted(blocks, y.blocks)
        _cross(x, y, x.wants(x.most, pivots[blocks[place]], radii[place]), None, to, None)
        row, ids, off = to.lists()
        return pa.table([x.ids.take(pa.array(row)), ids, off], ["left_id", "ids", "off"])

    dealt = asks.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(lefts)).cast("int"))
    copied = right.select("id", "v", "block", "cell", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))).alias("part"))
    return dealt.groupBy("cell", "part").cogroup(copied.groupBy("cell", "part")).applyInArrow(best, f"left_id {left_kind}, ids array<{kind}>, off array<bigint>")


def _meet(left: DataFrame, right: DataFrame, k: int, block_rows: int) -> DataFrame:
    """left_id, right_id and similarity: of each left row the best k of the blocks that it asks for, for each part of them."""
    parts = lambda df, n: df.groupBy("block").agg(F.ceil(F.count("*") / block_rows).alias(n))
    counts = parts(left, "left_n").join(parts(right, "right_n"), "block")  # a row a block
    side = lambda df, own, other: (
        df.join(counts, "block").select("block", F.pmod(F.xxhash64("id"), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), "id", "v")
    )
    id_type = left.schema["id"].dataType.simpleString()

    def pairs(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"left_id": [], "right_id": [], "similarity": []}
        if len(a) and len(b):
            b = b.sort_values("id")
            ids, vectors = b["id"].to_numpy(), np.stack(b["v"].to_numpy())
            for i in range(0, len(a), 512):
                own = a["id"].to_numpy()[i : i + 512]
                s = np.round(np.stack(a["v"].to_numpy()[i : i + 512]) @ vectors.T, DIGITS)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal ones in the order of their ids
                got = np.take_along_axis(s, best, 1)
                row, col = np.nonzero(got > -np.inf)
                out["left_id"].append(own[row])
                out["right_id"].append(ids[best[row, col]])
                out["similarity"].append(got[row, col])
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})

    key = ["block", "left_n", "right_n"]
    a, b = side(left, "left_n", "right_n").groupBy(*key), side(right, "right_n", "left_n").groupBy(*key)
    return a.cogroup(b).applyInPandas(pairs, f"left_id {id_type}, right_id {right.schema['id'].dataType.simpleString()}, similarity double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """A window group limit cuts each partition before the shuffle."""
    w = Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """left_id, ids and off, from all tasks. A row for each of the k nearest."""
    found = lists.groupBy("left_id").agg(F.flatten(F.collect_list("off")).alias("off"), F.flatten(F.collect_list("ids")).alias("ids"))
    best = found.select("left_id", F.posexplode(F.slice(F.sort_array(F.arrays_zip("off", "ids")), 1, k)))
    return best.select("left_id", F.col("col.ids").alias("right_id"), ((F.lit(UNITS) - F.col("col.off")) / F.lit(float(UNITS))).alias("similarity"), (F.col("pos") + 1).cast("int").alias("rank"))


def top_k(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str, k: int, same: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """left_id, right_id, similarity, rank: the k most similar right rows of each left row; ties go to the least id. same:
    both sides are one table, whose rows are no neighbours of themselves."""
    a, b = unit(left, left_id, left_vector), unit(right, right_id, right_vector)
    b = _kept(b.where("id IS NOT NULL") if same else b)  # a row without an id cannot be told from itself
    spark, n = left.sparkSession, b.count()
    empty = f"left_id {a.schema['id'].dataType.simpleString()}, right_id {b.schema['id'].dataType.simpleString()}, similarity double, rank int"
    if not n:
        return spark.createDataFrame([], empty)
    pivots = pivots_of(b, n, block_rows)
    right_rows = _kept(_nearest_pivot(b, pivots))
    size = right_rows.groupBy("block").agg(F.max("off").alias("radius"), F.count("*").alias("n")).orderBy("block").collect()  # a row a pivot
    b.unpersist()
    blocks, radii = np.array([r["block"] for r in size]), np.array([r["radius"] for r in size])
    width = pivots.shape[1]
    in_cell = lambda rows: max(1, min(CELL_BYTES // (8 * width), max(LEAST_CELL, -(-rows // CELLS))))
    first_cell, parts = _packed(np.array([r["n"] for r in size]), in_cell(n))
    place = np.repeat(np.arange(len(blocks)), parts)
    cell = first_cell[place] + np.arange(len(place)) - np.repeat(np.cumsum(parts) - parts, parts)
    of_block = spark.createDataFrame([(int(x), int(y), int(z)) for x, y, z in zip(blocks, first_cell, parts, strict=True)], "block int, cell int, parts int")
    placed = right_rows.join(F.broadcast(of_block), "block").select("id", "v", "block", (F.col("cell") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("cell"))
    any_block = F.lit(-1).alias("block")  # its own block, too: that may have several cells
    if same:
        own = _kept(_own_cells(placed, k, pivots, blocks, radii, int(cell[-1]) + 1))
        asks = _wanted(own.select("id", "v", any_block, F.col("cell").alias("own"), "reach"), pivots, blocks, radii, (place, cell), ["own"])
        met = asks.where("own <> cell").select(F.least("own", "cell").alias("a"), F.greatest("own", "cell").alias("b")).distinct().orderBy("a", "b").collect()  # cells by cells
        right_rows.unpersist()
        lists = own.where("ids IS NOT NULL").select(F.col("id").alias("left_id"), "ids", "off")
        return _merged(lists.unionByName(_between_cells(own, [(r["a"], r["b"]) for r in met], k, pivots, blocks, radii)) if met else lists, k)
    left_rows = _kept(_nearest_pivot(a, pivots[blocks]).withColumn("block", F.element_at(F.array(*(F.lit(int(x)) for x in blocks)), F.col("block") + 1)))
    n_left = left_rows.count()
    # a block of many copies is cut into parts as large as a cell, so that its rows are not copied once for each part
    first = _best(_meet(left_rows, right_rows, k, max(block_rows, in_cell(n))), k)
    found = first.groupBy(F.col("left_id").alias("id")).agg(F.count("*").alias("found"), F.min("similarity").alias("least"))
    full = F.col("found") >= k
    reach = F.when(full, F.sqrt(F.greatest(2 - 2 * (F.col("least") - 1 / UNITS), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    asking = left_rows.join(found, "id", "left").select("id", "v", F.col("block").alias("home"), any_block, reach.alias("reach"), F.when(full, F.col("least")).alias("worst"))
    asks = _wanted(asking, pivots, blocks, radii, (place, cell)).withColumn("block", F.col("home"))
    return _merged(_in_cells(asks, placed, k, pivots, blocks, radii, -(-n_left // in_cell(n_left)) or 1), k)
