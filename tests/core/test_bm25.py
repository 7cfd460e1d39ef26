"""The pruned search of BM25 against scoring everything."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factlode.operators import bm25, lexical


def scored(docs, queries, k, k1=1.2, b=0.75):
    df = Counter(t for d in docs.values() for t in set(d))
    mean = sum(map(len, docs.values())) / len(docs)
    out = set()
    for q, terms in queries.items():
        s = {d: sum(n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * ts.count(t) * (k1 + 1) / (ts.count(t) + k1 * (1 - b + b * len(ts) / mean)) for t, n in Counter(terms).items()) for d, ts in docs.items() if set(ts) & set(terms)}
        best = sorted((-round(x, 6), d) for d, x in s.items())[:k]
        out |= {(q, d, -x, i + 1) for i, (x, d) in enumerate(best)}
    return out


def made(seed):
    rng = random.Random(seed)
    term = lambda: f"t{int(rng.paretovariate(0.6)) % 60}"
    docs = {f"d{i:03d}": [term() for _ in range(rng.randrange(0, 30))] for i in range(150)}
    docs |= {f"e{i:03d}": docs[f"d{i:03d}"] for i in range(0, 150, 3)}  # ties
    return docs, {f"q{i:02d}": [term() for _ in range(rng.randrange(0, 9))] for i in range(80)}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_search_equals_scoring_everything(spark, k):
    docs, queries = made(k)
    df = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in rows.items()], "id string, t string")
    got = lexical.bm25_search(df(docs), df(queries), "id", "t", "id", "t", k)
    assert got.dtypes == [("query", "string"), ("doc", "string"), ("score", "double"), ("rank", "int")]
    assert {tuple(r) for r in got.collect()} == scored(docs, queries, k)


@pytest.mark.parametrize("heavy", [0, 10**6])
def test_index_in_parts(monkeypatch, tmp_path, heavy):
    """Small parts, blocks of few queries and no or many dense rows give the same."""
    import numpy as np
    import pyarrow.parquet as pq

    monkeypatch.setattr(bm25, "INDEX_POSTINGS", 300)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 30)
    monkeypatch.setattr(bm25, "HEAVY_BYTES", heavy)
    docs, queries = made(9)
    words = pa.array(sorted({t for q in queries.values() for t in q}))
    batch = lambda rows, name: pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array(list(rows.values()), pa.list_(pa.string()))], names=[name, "terms"])
    packed, files = pa.Table.from_batches(bm25.packer(words)([batch(docs, "doc")])), []
    for i in range(0, len(docs), 40):
        files.append(f"file://{tmp_path}/{i}.parquet")
        pq.write_table(packed.slice(i, 40), files[-1][7:])
    df = np.array([sum(w in d for d in docs.values()) for w in words.to_pylist()], float)
    mean = sum(map(len, docs.values())) / len(docs)
    run = bm25.searcher(words, files, np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), lambda n: 1.2 * (0.25 + 0.75 * n / mean), 1.2, 4)
    asked = pa.Table.from_batches([batch(queries, "query")]).to_batches(max_chunksize=20)
    assert {tuple(r.values()) for b in run(asked) for r in b.to_pylist()} == scored(docs, queries, 4)


def test_search_of_odd_inputs(spark):
    """Numbers as ids, a question in two rows, texts without terms."""
    docs = spark.createDataFrame([(2, "甲乙 甲乙"), (1, "甲乙 甲乙"), (3, "。"), (4, "")], "id long, t string")
    q = spark.createDataFrame([(7, "甲乙"), (7, "甲乙 丙丁"), (8, "、")], "id int, t string")
    got = lexical.bm25_search(docs, q, "id", "t", "id", "t", 3).orderBy("rank").collect()
    assert [(r["query"], r.doc, r["rank"]) for r in got] == [(7, 1, 1), (7, 2, 2)] and got[0].score == got[1].score == pytest.approx(2 * math.log(2) * 2 * 2.2 / (2 + 1.2 * 1.75), abs=1e-6)
    assert lexical.bm25_search(docs.where(F.col("id") > 2), q, "id", "t", "id", "t", 3).count() == 0 and lexical.bm25_search(docs, q.where("id = 8"), "id", "t", "id", "t", 3).count() == 0
