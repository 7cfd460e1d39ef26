"""A corpus as token ids: short texts whole, long ones as a tree of parts that are encoded apart and joined exactly."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from factlode.llm.bpe import Encoded, bpe

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

#: Texts of more characters are cut into parts of this length, which are encoded in parallel.
PART_CHARS = 4096
#: Characters that one call of the encoder takes.
SLICE_CHARS = 1_000_000


def slices(texts: pa.Array) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """Ranges of rows with at most SLICE_CHARS characters (or one row): first, end, the texts one behind the other, their lengths.
    Null counts as empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + SLICE_CHARS, "right")))
        yield a, b, "".join(texts.slice(a, b - a).to_pylist()), sizes[a:b]
        a = b


def _whole(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, blob, sizes in slices(batch.column(1)):
                ids, n = bpe(rank_file).encode(blob, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])

    return run


def _cut(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = [r["text"][i : i + part_chars] for i in range(0, len(r["text"]), part_chars)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r["key"]] * n, pa.string()), pa.array(parts, pa.string())], names=["row", "part", "key", "text"])

    return run


_PART = "row long, part long, key string, text string, starts binary, firsts binary, ids binary"


def _parts(rank_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bpe(rank_file).encoded(t) for t in batch.column(3).to_pylist()]
            raw = lambda f: pa.array([None if x is None else f(x).astype(np.int64).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], raw(lambda x: x.starts), raw(lambda x: x.firsts), raw(lambda x: x.ids)], names=["row", "part", "key", "text", "starts", "firsts", "ids"])

    return run


def _tree(rank_file: str):
    def run(parts: pa.Table) -> pa.Table:
        rows = parts.sort_by("part").to_pylist()
        own = bpe(rank_file)
        if any(r["starts"] is None for r in rows):
            ids = np.array(own.plain.encode_ordinary("".join(r["text"] for r in rows)), np.int32)
        else:
            arr = lambda x: np.frombuffer(x, np.int64)
            ids = own.tree([Encoded(r["text"], arr(r["starts"]), arr(r["firsts"]), arr(r["ids"]).astype(np.int32)) for r in rows]).ids
        return pa.table({"key": pa.array([rows[0]["key"]], pa.string()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", rank_file: str = RANK_FILE, part_chars: int = PART_CHARS) -> DataFrame:
    """``id_col`` and the token ids of ``text_col`` by the tokenizer of ``rank_file``, without special tokens, one row per row of ``df``.

    Null, empty: an empty list.  White space is text like any other.  Strings of special tokens are ordinary text.
    A null id stays null; rows of equal id or text are encoded each.  Other columns, whatever their names, are left out.
    Texts of more than ``part_chars`` characters are cut into parts; the parts are encoded wherever there is room and
    joined pair by pair, a window around each seam being encoded again until both sides agree.  The result is that of the whole text.
    """
    kind = df.schema[id_col].dataType
    base = df.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = base.where(size <= part_chars).mapInArrow(_whole(rank_file), "key string, ids array<int>")
    long = (
        base.where(size > part_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(_cut(part_chars), "row long, part long, key string, text string")
        .repartition("row", "part")
        .mapInArrow(_parts(rank_file), _PART)
        .groupBy("row")
        .applyInArrow(_tree(rank_file), "key string, ids array<int>")
    )
    return short.unionAll(long).select(F.col("key").cast(kind).alias(id_col), F.col("ids").alias(out_col))


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text", rank_file: str = RANK_FILE) -> DataFrame:
    """``id_col`` and the text that ``ids_col`` stands for; null and empty lists: an empty text.  An id that the tokenizer lacks is an error."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = bpe(rank_file).plain
        for batch in batches:
            texts = [plain.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    got = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return got.select(F.col("id").alias(id_col), F.col("text").alias(out_col))


def count_tokens(df: DataFrame, text_col: str, out_col: str, rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` without ``text_col`` but with the number of its tokens as ``out_col`` (null and empty: 0)."""
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            n = [bpe(rank_file).count(blob, sizes) for _, _, blob, sizes in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], names=[*kept, out_col])

    return df.select(*kept, text_col).mapInArrow(run, schema)
