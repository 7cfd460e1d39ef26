"""Exact dense retrieval: blocks of vectors against a bounded set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlode.operators.lexical import top

#: Query vectors that go out to every task at most, and, where there are more, queries and rows of one cell of their grid.
QUERY_BLOCK, ROW_BLOCK = 20_000, 200_000


def dense_search(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, top_k: int = 20, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``top_k`` rows of each query by cosine, all rows scored: query, doc, score (six places), rank; ties by doc.

    Vectors that are null, of another length than most, zero or not finite are no neighbours and ask nothing.
    Up to ``query_block`` queries go out to all tasks; more are laid out with the rows in a grid of blocks, of which each
    cell is one task.  A task multiplies its rows with its queries and keeps its own best ``top_k`` (with all ties at the end), so that
    no more than that goes on per task and query.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    ok = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    dim = rows.where(ok(vec_col)).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    r = rows.select(F.col(id_col).alias("doc"), F.col(vec_col).alias("v"))
    kind = r.schema["doc"].dataType.simpleString()
    if dim is None:
        return rows.sparkSession.createDataFrame([], f"query {kind}, doc {kind}, score double, rank int")
    asked = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("v")).where((F.size("v") == dim["d"]) & F.col("query").isNotNull())
    r = r.where((F.size("v") == dim["d"]) & F.col("doc").isNotNull())
    out = f"query {kind}, doc {kind}, score double"
    first = asked.limit(query_block + 1).toArrow()  # bounded by the block
    if not first.num_rows:
        return rows.sparkSession.createDataFrame([], f"{out}, rank int")
    if first.num_rows <= query_block:
        return top(r.mapInArrow(_nearest(*_unit(first), top_k), out), top_k)
    blocks, cells = -(-asked.count() // query_block), max(1, -(-r.count() // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = r.select("doc", "v", F.pmod(F.xxhash64("doc"), F.lit(cells)).cast("int").alias("c"), every(blocks).alias("b"))
    right = asked.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("b"), every(cells).alias("c"))
    return top(left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(_cell(top_k), out), top_k)


def _unit(t) -> tuple[pa.Array, np.ndarray]:
    v = t.column(1)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    ids = t.column(0)
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.filter(pa.array(good)), m[good] / norm[good, None]


def _nearest(ids: pa.Array, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, m = _unit(batch)
            if not len(docs):
                continue
            score = np.round(q @ m.T, 6) + 0.0
            if score.shape[1] > k:
                floor = np.partition(score, -k, axis=1)[:, -k]
                a, b = np.nonzero(score >= floor[:, None])
            else:
                a, b = np.nonzero(np.ones_like(score, bool))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), docs.take(pa.array(b)), pa.array(score[a, b])], names=["query", "doc", "score"])

    return run


def _cell(k: int):
    """One cell of the grid: its rows in slices against its queries."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asked.num_rows:
            ids, q = _unit(asked.select(["query", "v"]))
            batches = pa.Table.from_arrays([rows.column("doc"), rows.column("v")], names=["doc", "v"]).combine_chunks().to_batches(max_chunksize=10_000)
            parts = list(_nearest(ids, q, k)(iter(batches)))
        empty = pa.table({"query": asked.column("query").slice(0, 0), "doc": rows.column("doc").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *[pa.Table.from_batches([p]) for p in parts]])

    return run
