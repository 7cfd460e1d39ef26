"""What the tasks of a BM25 search run: texts as counted term numbers, and the best documents of many queries over one index after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

#: Postings that a task holds at once, queries of one pass over the index, bytes for the weights of frequent terms by document, postings of a long list.
INDEX_POSTINGS, QUERY_BLOCK, HEAVY_BYTES, LONG = 8_000_000, 50_000, 64_000_000, 1_000
#: Scores that differ by less may be equal when rounded to six places.
SLACK = 2e-6


def counted(lists: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms that are among ``words``, as row, number (ascending within the row) and count; and how many terms of any kind each row has."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    ids = pc.index_in(lists.flatten(), value_set=words)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    key, count = np.unique(np.repeat(np.arange(len(lists), dtype=np.int64), n)[known] * max(1, len(words)) + ids.drop_null().to_numpy(), return_counts=True)
    return key // max(1, len(words)), key % max(1, len(words)), count, n


def packer(words: pa.Array):
    """doc, terms -> doc, len, and the numbers and counts of the terms in ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, tf, n = counted(b.column("terms"), words)
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n.astype(np.int32)), *lists], names=["doc", "len", "terms", "tfs"])

    return run


class Index:
    """Postings by term with their weights, of documents in the order of their ids."""

    def __init__(self, packed: pa.Table, idf: np.ndarray, norm, k1: float):
        packed = packed.sort_by("doc").combine_chunks()
        self.docs, self.n = packed.column("doc").combine_chunks(), packed.num_rows
        flat = lambda c: packed.column(c).combine_chunks()
        terms = flat("terms").flatten().to_numpy()
        # sixteen bits are sorted by radix
        order = np.argsort(terms.astype(np.uint16) if len(idf) < 1 << 16 else terms, kind="stable").astype(np.int32)
        size = np.bincount(terms, minlength=len(idf))
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), pc.list_value_length(flat("terms")).to_numpy(zero_copy_only=False))[order]
        tf, rest = flat("tfs").flatten().to_numpy()[order], norm(packed.column("len").to_numpy().astype(np.float64))
        del order, terms, packed
        self.weight = np.empty(len(tf))
        for i in range(0, len(tf), 1 << 18):  # in slices, for what lies between
            part = slice(i, i + (1 << 18))
            f = tf[part].astype(np.float64)
            of = np.searchsorted(self.at, np.arange(i, i + len(f)), "right") - 1
            self.weight[part] = idf[of] * (f * (k1 + 1) / (f + rest[self.doc[part]]))
        has = np.flatnonzero(size)
        self.most = np.zeros(len(idf))
        if len(has):
            self.most[has] = np.maximum.reduceat(self.weight, self.at[has])
        heavy = np.argsort(-size, kind="stable")[: HEAVY_BYTES // (8 * max(1, self.n))]
        heavy = heavy[size[heavy] > self.n // 16]
        self.row, self.dense = np.full(len(idf), -1), np.zeros((len(heavy), self.n))
        self.row[heavy] = np.arange(len(heavy))
        for r, t in enumerate(heavy.tolist()):
            self.dense[r, self.doc[self.at[t] : self.at[t + 1]]] = self.weight[self.at[t] : self.at[t + 1]]


def indexes(files: list[str], idf: np.ndarray, norm, k1: float) -> Iterator[Index]:
    """The packed documents as one index after the other, none far above INDEX_POSTINGS."""
    held, n = [], 0

    def index() -> Index:
        table = pa.Table.from_batches(held)
        held.clear()
        made = Index(table, idf, norm, k1)
        del table
        pa.default_memory_pool().release_unused()
        return made

    for f in files:
        at, path = fs.FileSystem.from_uri(f.replace("s3a://", "s3://", 1))
        with at.open_input_file(path) as source:
            for b in pq.ParquetFile(source).iter_batches(16_384):
                held.append(b)
                n += len(b.column("terms").flatten())
                if n >= INDEX_POSTINGS:
                    n = 0
                    yield index()
    if held:
        yield index()


def best_of(index: Index, query: np.ndarray, term: np.ndarray, qtf: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document's place and rounded score of the best ``k`` of each query within ``index``; without those below ``least``, which others have reached.

    Rare terms come first.  Once what is left cannot lift a document without any of the terms so far to the k-th best score known, no more documents
    are taken up, and those that cannot get there either are dropped; the rest are summed up in full.  To know such a score early, the
    best so far are summed up in full before a long list is read.  So the result is that of scoring all.
    """
    size, bound, row = index.at[term + 1] - index.at[term], index.most[term] * qtf, index.row[term]
    order = np.lexsort((-bound, size, row >= 0, query))
    order = order[size[order] > 0]
    query, term, qtf, bound, row = (x[order] for x in (query, term, qtf, bound, row))
    ends = np.searchsorted(query, np.arange(len(least) + 1))
    dense = ends[1:] - np.bincount(query[row >= 0], minlength=len(least))  # each query's terms with a row of their own come last
    total = np.concatenate([[0.0], np.cumsum(bound)])
    left = (total[ends[1:]][query] - total[1:]).tolist()  # bounds of the terms after this one
    whole = (total[ends[1:]] - total[ends[:-1]]).tolist()
    times, starts, stops, ends, dense, floors = qtf.tolist(), index.at[term].tolist(), index.at[term + 1].tolist(), ends.tolist(), dense.tolist(), least.tolist()
    acc, spread, doc, weight, rows, qtf = np.zeros(index.n), np.zeros(index.n), index.doc, index.weight, row[:, None], qtf.astype(np.float64)

    def in_full(at: np.ndarray, sums: np.ndarray, i: int, h: int, z: int) -> np.ndarray:
        """With the terms from i to z, those from h on having rows of their own."""
        for j in range(i, h):
            d = doc[starts[j] : stops[j]]
            if len(at) * 8 > len(d):
                spread[d] = weight[starts[j] : stops[j]]
                sums = sums + spread[at] * times[j]
                spread[d] = 0.0
            else:
                p = np.minimum(d.searchsorted(at), len(d) - 1)
                sums = sums + np.where(d[p] == at, weight[starts[j] + p], 0.0) * times[j]
        h = max(i, h)
        return sums + qtf[h:z] @ index.dense[rows[h:z], at] if h < z else sums

    out_q, out_d, out_s = [], [], []
    for q, floor in enumerate(floors):
        i, z, h, rest = ends[q], ends[q + 1], dense[q], whole[q]
        if i == z or rest < floor - 2 * SLACK:
            continue
        parts, n = [], 0
        while i < z and rest >= floor - 2 * SLACK:
            d, w = doc[starts[i] : stops[i]], weight[starts[i] : stops[i]]
            old = acc[d]
            acc[d] = old + (w if times[i] == 1 else w * times[i])
            parts.append(d[old == 0.0] if n else d)
            n += len(parts[-1])
            rest = left[i]
            i += 1
            if n >= k and i < z and rest >= floor - 2 * SLACK and stops[i] - starts[i] > max(LONG, n // 2):
                parts = [np.concatenate(parts)] if len(parts) > 1 else parts
                at, sums = parts[0], acc[parts[0]]
                if n > 2 * k:
                    best = sums.argpartition(n - 2 * k)[n - 2 * k :]
                    at, sums = at[best], sums[best]
                sums = in_full(at, sums, i, h, z)
                sums.partition(len(sums) - k)
                floor = max(floor, float(sums[len(sums) - k]))
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        sums = acc[at]
        acc[at] = 0.0
        keep = sums >= floor - rest - 2 * SLACK
        at, sums = at[keep], sums[keep]
        while i < z and len(at) > 4 * k:  # term by term while many are left
            sums = in_full(at, sums, i, min(h, i + 1), i + 1)
            keep = sums >= floor - left[i] - 2 * SLACK
            at, sums = at[keep], sums[keep]
            i += 1
        sums = in_full(at, sums, i, h, z)
        if len(at) > k:
            keep = sums >= np.partition(sums, len(at) - k)[len(at) - k] - SLACK
            at, sums = at[keep], sums[keep]
        sums = np.floor(sums * 1e6 + 0.5) / 1e6
        first = np.lexsort((at, -sums))[:k]
        out_q.append(np.full(len(first), q))
        out_d.append(at[first])
        out_s.append(sums[first])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_d, np.int64), (out_s, np.float64)))


def _ranked(found: pa.Table, n: int, k: int) -> tuple[pa.Table, np.ndarray]:
    """The best ``k`` of each query with their rank, and the k-th best score of each (minus infinity where there are fewer)."""
    found = found.sort_by([("q", "ascending"), ("score", "descending"), ("doc", "ascending")])
    q = found.column("q").to_numpy()
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    found = found.append_column("rank", pa.array(rank.astype(np.int32))).filter(pa.array(rank <= k))
    least = np.full(n, -np.inf)
    last = found.filter(pc.equal(found.column("rank"), k))
    least[last.column("q").to_numpy()] = last.column("score").to_numpy()
    return found, least


def searcher(words: pa.Array, files: list[str], idf: np.ndarray, norm, k1: float, k: int):
    """query, terms -> query, doc, score, rank."""

    def search(asked: pa.Table) -> Iterator[pa.RecordBatch]:
        asked = asked.combine_chunks()
        query, term, qtf, _ = counted(asked.column("terms").combine_chunks(), words)
        found, least = None, np.full(asked.num_rows, -np.inf)
        for index in indexes(files, idf, norm, k1):
            q, d, s = best_of(index, query, term, qtf, least, k)
            new = pa.table({"q": q, "doc": index.docs.take(pa.array(d)), "score": s})
            found, least = _ranked(new if found is None else pa.concat_tables([found.drop_columns("rank"), new]), len(least), k)
        if found is not None and found.num_rows:
            query = asked.column("query").combine_chunks().take(found.column("q").combine_chunks())
            yield from pa.table({"query": query, "doc": found.column("doc"), "score": found.column("score"), "rank": found.column("rank")}).combine_chunks().to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= QUERY_BLOCK:
                yield from search(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from search(pa.Table.from_batches(held))

    return run
