"""Vectorised helpers that the operators of this subpackage share inside their tasks.

They work on the raw UTF-8 buffers of Arrow string columns, a quarter of a megabyte at a time, so that memory does not
depend on how many rows a batch holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators of words, space and U+0009 to U+000D.
SEPARATORS = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 18
#: Bytes of a row group of a stored table, which the task that writes it holds; Parquet's own default is 128 MB.
GROUP_BYTES = 16 << 20
BLOCK_BYTES = 1 << 17
#: Shuffle files are deleted at the end of a query; a lost one is computed anew.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_SETTING, ROWS_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"

IS_SEP = np.zeros(256, bool)
IS_SEP[list(SEPARATORS)] = True
#: For terms: all of ASCII but letters, digits and the apostrophe separates.
TERM_SEP = np.array([b < 128 and not chr(b).isalnum() and b != 39 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


_CODES = _byte_codes(11)
_CODES_LOWER = _CODES[_LOWER]
#: For lines: letters in lower case, all digits alike.
_FOLD = _LOWER.copy()
_FOLD[48:58] = 48
FOLDED = _CODES[_FOLD]


def _letter_pairs() -> np.ndarray:
    """For two bytes of UTF-8 those of the letter in lower case: Latin-1, Latin Extended-A, Greek and Cyrillic."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for c in (*range(0xC0, 0x180), *range(0x370, 0x530)):
        upper, lower = chr(c).encode(), chr(c).lower().encode()
        if len(upper) == len(lower) == 2:
            table[upper[0] << 8 | upper[1]] = lower[0] << 8 | lower[1]
    return table


_LETTERS = _letter_pairs()


def fold_letters(data: np.ndarray) -> np.ndarray:
    """Bytes with letters of two bytes in lower case; none gets longer or shorter."""
    if not len(data) or data.max() < 0xC3:
        return data
    lead = np.flatnonzero(data >= 0xC3)  # pairs that begin longer letters stay as they are
    lead = lead[lead + 1 < len(data)]
    if not len(lead):
        return data
    pair = _LETTERS[data[lead].astype(np.uint16) << 8 | data[lead + 1]]
    data = data.copy()
    data[lead], data[lead + 1] = pair >> 8, pair & 255
    return data


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values so that all their bits depend on all bits of the input."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case and all digits as 0."""
    return _FOLD[data]


def _pow(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin and end (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has `most` bytes of text or one row, and fewer than 4096 rows."""
    if not batch.num_rows:
        return
    _, at = text_buffer(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, first + 4095)
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, at: np.ndarray, lower: bool = True, sep: np.ndarray = IS_SEP, codes: np.ndarray | None = None, unspaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (64 bits), row, start and end of each word; words do not cross rows. sep: which bytes separate (terms, that is
    words by TERM_SEP, are in lower case beyond ASCII too);
    codes: numbers of the bytes, where some are to count as the same. unspaced: characters of three or four bytes, as in
    scripts without spaces, are words of their own."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    begin, n = 0, len(data)
    codes = codes if codes is not None else _CODES_LOWER if lower else _CODES
    while begin < n:
        end = min(n, begin + BLOCK_BYTES)
        while end < n:  # a block ends behind a separator
            gap = np.flatnonzero(sep[data[end - 4096 if end - 4096 > begin else begin : end]])
            if len(gap):
                end = max(end - 4096, begin) + int(gap[-1]) + 1
                break
            end = min(n, end + BLOCK_BYTES)
        block = data[begin:end]
        inside = ~sep[block]
        fresh = np.zeros(len(block) + 1, bool)
        lo, hi = np.searchsorted(at, begin, "left"), np.searchsorted(at, end, "right")
        fresh[at[lo:hi] - begin] = True
        fresh[0] = fresh[-1] = True
        if unspaced:
            lead = np.flatnonzero(block >= 0xE0)
            fresh[lead] = True
            fresh[np.minimum(lead + 3 + (block[lead] >= 0xF0), len(block))] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | fresh[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | fresh[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(codes[fold_letters(block) if sep is TERM_SEP else block] * _pow("p", _P, len(block)), out=total[1:])
            h = mix((total[ends] - total[starts]) * _pow("inverse", _P_INV, len(block))[starts])
            out.append((h, starts + begin, ends + begin))
        begin = end
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    h, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, np.searchsorted(at, starts, "right") - 1, starts, ends


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the sorted row numbers of each of n rows begin; the last entry is their count."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words within a row, and their rows."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = (s ^ h[i : i + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * i)
        s ^= s >> np.uint64(31)
    own = rows[:n] == rows[k - 1 :]
    return mix(s[own]), rows[:n][own]


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the folder that the cluster names in spark.checkpoint.dir, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a folder only where the session has none and all runs on one machine, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents. Texts go to Python workers BATCH_ROWS at a time, unless the session asks for another size
    than Spark's own default: ten thousand texts in one Arrow batch take memory on both sides for nothing."""
    if spark.conf.get(ROWS_SETTING) == ROWS_DEFAULT:
        spark.conf.set(ROWS_SETTING, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """doc_id and label of the rows to learn from: remainder modulo 5 not 0, one row an id, 1 wins over 0."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def sample_by_class(labels: DataFrame, each: int) -> tuple[list[tuple], list[int]]:
    """(doc_id, label) of at most `each` rows of each class, those with the least hash of their id, and the classes' counts."""
    counts = dict(labels.groupBy("label").count().collect())
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    rows = [tuple(r) for c in (0, 1) if c in counts for r in labels.where(F.col("label") == c).orderBy(key, "doc_id").limit(each).collect()]
    return rows, [int(counts.get(c, 0)) for c in (0, 1)]


def sampled_texts(docs: DataFrame, labels: DataFrame, rows: list[tuple]) -> DataFrame:
    """doc_id, text, label of the sampled rows; the sample is bounded, so its side is broadcast."""
    chosen = docs.sparkSession.createDataFrame(rows, labels.schema)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart that share an id or have none: the id and a hash of the text, ordered by id, null first."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of_text"))


def shortest_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id where it tells all rows apart, else row_key; both order rows alike."""
    shared = docs.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    return F.col(id_col) if shared.isEmpty() else row_key(id_col, text_col)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def parts(rows: int, each: int = 200_000) -> int:
    """Tasks for so many rows of a few numbers; fewer than the session's partitions where rows are few."""
    return max(1, -(-rows // each))


def table_path(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, narrow: bool = False) -> DataFrame:
    """Writes df as a table (in the session's checkpoint folder) and reads it back; smaller than a checkpoint of wide rows.
    The shuffle files of the write go with it, as nothing reads them once the table is there. narrow: Python workers get rows
    of a few numbers, as many at a time as Spark's own default says."""
    spark = df.sparkSession
    path = path or table_path(spark)
    settings = {CLEANUP_SETTING: "true"}
    if narrow and spark.conf.get(ROWS_SETTING) == BATCH_ROWS:
        settings[ROWS_SETTING] = ROWS_DEFAULT
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
