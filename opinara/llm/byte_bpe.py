"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

Short texts are encoded where they lie. A longer text is cut into chunks that overlap; chunks of one text are
pre-tokenised by different tasks. Where the pre-token boundaries of two neighbours agree inside their overlap they have
resynchronised: the text is cut there and the pieces are encoded in parallel. Where an overlap has no common boundary
the pre-tokens of the joined chunks are found again before the next cut. Decoding concatenates the bytes of the ids.

A null text is the empty text, which has no ids; repeated rows give repeated results; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import textkit as tk

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32768, 512


@lru_cache(2)
def _encoding(path: str | None):
    """The encoder and the bytes of each id; once for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _ids(text: str, path: str | None) -> bytes:
    return np.array(_encoding(path)[0].encode_ordinary(text), "<u4").tobytes()


def boundaries(text: str, start: int, lo: int, hi: int, final: bool) -> list[int]:
    """Ends of pre-tokens of a chunk, as places of the whole text between lo and hi, behind a visible character.

    What follows such a place cannot change the pre-tokens before it. Unless the chunk ends its text, its last
    pre-token may go on and its end does not count."""
    found = [m.end() for m in _pattern().finditer(text)]
    if not final and found:
        found.pop()
    return [start + e for e in found if lo <= start + e <= hi and not text[e - 1].isspace()]


def stitch(chunks: list[str], heads: list[list[int]], tails: list[list[int]], size: int, overlap: int) -> list[str]:
    """The pieces of one text: cut where the boundaries of neighbouring chunks agree."""
    starts = [i * size for i in range(len(chunks))]
    text = "".join(c[:size] for c in chunks[:-1]) + chunks[-1]
    pieces, cut = [], 0
    fresh = tails[0]
    for i in range(1, len(chunks)):
        common = sorted(set(fresh) & set(heads[i]))
        if common:
            pieces.append(text[cut : common[0]])
            cut, fresh = common[0], tails[i]
        elif i + 1 < len(chunks):  # not resynchronised: true boundaries of what has been joined
            end = starts[i] + len(chunks[i])
            fresh = boundaries(text[cut:end], cut, starts[i + 1], end, end == len(text))
    return [p for p in [*pieces, text[cut:]] if p]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary: unsigned little-endian 32-bit numbers) of each row. vocabulary: path of the rank file."""
    if overlap >= chunk:
        raise ValueError("overlap must be shorter than a chunk")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                ids = [_ids(t, vocabulary) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The overlapping chunks of long texts, cut once and given a few at a time."""
        for batch in batches:
            for part in tk.slices(batch, "text"):
                for key, text in zip(part.column("doc_id"), part.column("text").to_pylist(), strict=True):
                    n = max(1, -(-(len(text) - overlap) // chunk))
                    sha = hashlib.sha256(text.encode()).hexdigest()
                    for i in range(0, n, 32):
                        own = range(i, min(n, i + 32))
                        cuts = [text[j * chunk : None if j + 1 == n else (j + 1) * chunk + overlap] for j in own]
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), key.type), pa.array([sha] * len(own)), pa.array(list(own), pa.int32()), pa.array([n] * len(own), pa.int32()), pa.array(cuts, pa.string())], ["doc_id", "sha", "chunk_no", "n_chunks", "text"])

    def pretokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads, tails = [], []
            for text, i, n in zip(f["text"], f["chunk_no"], f["n_chunks"], strict=True):
                start, final = i * chunk, i + 1 == n
                near = boundaries(text, start, start, start + max(chunk, len(text)), final)
                heads.append([b for b in near if b <= start + overlap])
                tails.append([b for b in near if b >= start + chunk])
            yield f.assign(head=heads, tail=tails)

    def pieces(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        copies = int((f["chunk_no"] == 0).sum())
        f = f.drop_duplicates("chunk_no").sort_values("chunk_no")
        cut = stitch(list(f["text"]), [list(x) for x in f["head"]], [list(x) for x in f["tail"]], chunk, overlap)
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]] * len(cut), "sha": key[1], "copies": copies, "piece_no": range(len(cut)), "text": cut})

    def encode_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ids=[_ids(t, vocabulary) for t in f["text"]]).drop(columns="text")

    def joined(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids, copies = b"".join(f.sort_values("piece_no")["ids"]), int(f["copies"].iloc[0])
        return pd.DataFrame({"doc_id": [f["doc_id"].iloc[0]] * copies, "ids": [ids] * copies})

    is_long = F.char_length("text") > chunk
    short = docs.where(~is_long).mapInArrow(whole, f"doc_id {kind}, ids binary")
    chunks = (
        docs.where(is_long)
        .mapInArrow(cut_up, f"doc_id {kind}, sha string, chunk_no int, n_chunks int, text string")
        .repartition("sha", "chunk_no")
        .mapInPandas(pretokenise, f"doc_id {kind}, sha string, chunk_no int, n_chunks int, text string, head array<bigint>, tail array<bigint>")
    )
    long = (
        chunks.groupBy("doc_id", "sha")
        .applyInPandas(pieces, f"doc_id {kind}, sha string, copies int, piece_no int, text string")
        .repartition("sha", "piece_no")
        .mapInPandas(encode_pieces, f"doc_id {kind}, sha string, copies int, piece_no int, ids binary")
        .groupBy("doc_id", "sha")
        .applyInPandas(joined, f"doc_id {kind}, ids binary")
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id and data (the raw bytes of the ids); with digest, counts and hashes in place of the data."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoding(vocabulary)[1]
        for batch in batches:
            counts, sums, data = [], [], []
            for x in batch.column("ids"):
                ids = np.frombuffer(raw := x.as_py(), "<u4")
                own = b"".join(map(table.__getitem__, ids.tolist()))
                counts.append(len(ids))
                sums.append(hashlib.sha256(raw).hexdigest())
                data.append(hashlib.sha256(own).hexdigest() if digest else own)
            keys = batch.column("doc_id")
            if digest:
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(data, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.array(data, pa.binary())], ["doc_id", "data"])

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "data binary"
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, {fields}")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as hashes."""
    return decode(encode(tk.documents(spark, sf_dir)), digest=True)
