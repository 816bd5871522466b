"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks against bands for their length.

Text that repeats itself compresses far below prose, text without structure far above. A ratio is compressed bytes over
raw bytes; as it falls with length, each band holds for a range of lengths. A text is kept if it passes the base rules,
its own ratio lies in the band of its length, and no more than `bad_share` of its chunks lie outside the band of theirs.

A null or empty text has no words and fails the base rules. Rows are judged one by one, so repeated rows repeat, an empty
table gives an empty one, and a long text has as many chunks as it takes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

CHUNK = 2048
#: Shortest length in bytes, then the least and the greatest ratio from there on.
BANDS = ((0, 0.0, 10.0), (128, 0.30, 1.02), (512, 0.28, 0.90), (2048, 0.26, 0.72), (8192, 0.22, 0.62), (65536, 0.18, 0.60))
BAD_SHARE = 0.34
SYMBOLS = "#*$%&|<>"  # fixed value


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, duplicate lines, words in repeated 3-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()  # bytes split at exactly the separators
    chars = len(text) - sum(text.count(c) for c in tk.SEPARATORS.decode())
    symbols = sum(text.count(c) for c in SYMBOLS)
    filled = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in tokens], np.int64)
    repeated = 0
    if len(ids) > 3 and len(seen) < len(ids):
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[window] > 1)
        covered = np.zeros(len(ids), bool)
        for i in range(3):
            covered[again + i] = True
        repeated = int(covered.sum())
    return len(tokens), chars, symbols, len(filled) - len(set(filled)), repeated


def outside(length: int, ratio: float, bands: tuple = BANDS) -> bool:
    _, low, high = next(b for b in reversed(bands) if length >= b[0])
    return not low <= ratio <= high


def chunks(raw: bytes, size: int) -> list[bytes]:
    """Consecutive chunks; a rest of half a chunk or less belongs to the last one. None where one would be the whole text."""
    if len(raw) <= size:
        return []
    starts = list(range(0, len(raw) - size // 2, size))
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple = BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE, level: int = 3) -> DataFrame:
    """Base counts, ratios and the verdict for each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            for part in tk.slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    counts = base_counts(text)
                    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                    raw = text.encode()
                    ratio = len(squeeze(raw)) / len(raw) if raw else 0.0
                    cut = chunks(raw, chunk)
                    ratios = [len(squeeze(c)) / len(c) for c in cut]
                    bad = sum(outside(len(c), r, bands) for c, r in zip(cut, ratios, strict=True))
                    kept = not failed and not outside(len(raw), ratio, bands) and bad <= bad_share * len(cut)
                    rows.append((*counts, failed, kept, ratio, min(ratios, default=ratio), max(ratios, default=ratio), bad))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "min_chunk_ratio", "max_chunk_ratio", "n_bad_chunks"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, min_chunk_ratio double, max_chunk_ratio double, n_bad_chunks bigint")


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(tk.documents(spark, sf_dir))
