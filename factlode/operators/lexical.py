"""Lexical retrieval: postings, statistics and BM25 over many queries at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from factlode.functions.text import tokens
from factlode.operators import bm25
from factlode.runtime import materialise, once_each, width

K1, B = 1.2, 0.75


def terms_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and its terms in order.  Repeated rows of one id count once; null texts have no terms."""
    d = once_each(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null"), "doc")
    return d.select("doc", tokens(F.col("text")).alias("terms"))


def _postings(terms: DataFrame) -> DataFrame:
    return terms.select("doc", "len", F.explode("terms").alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, doc, tf and the document's length in terms."""
    return _postings(terms_of(docs, id_col, text_col).withColumn("len", F.size("terms")))


def term_stats(post: DataFrame) -> DataFrame:
    """term, df and collection frequency."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_search(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, top_k: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """The ``top_k`` documents of each query by BM25: query, doc, score, rank; ties by doc, only documents that share a term.

    Every query is searched over every document.  Texts are cut into terms once, where they lie, and kept as numbers and counts of the terms that
    are asked for, in the shared folder.  Each task takes its queries through that index part by part, so neither postings nor scores are
    shuffled (``bm25.best_of``).  The distinct terms of all queries, with their document frequencies, go to every task.
    Scores are rounded to six places before ranking, so that the order of summing does not decide.
    """
    if top_k <= 0 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("top_k must be positive, k1 not negative and b within [0, 1]")
    spark = docs.sparkSession
    n = width(spark)
    q = queries.select(F.col(query_id).alias("query"), tokens(F.col(query_text)).alias("terms"))
    q = materialise(q.repartition(n, "query").groupBy("query").agg(F.flatten(F.collect_list("terms")).alias("terms")), "queries")
    words = q.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").combine_chunks().sort()
    d = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(doc_text)).alias("terms")).where("doc is not null")
    kind = d.schema["doc"].dataType.simpleString()
    # packed before equal ids meet, so that no text is shuffled
    packed = materialise(once_each(d.mapInArrow(bm25.packer(words), f"doc {kind}, len int, terms array<int>, tfs array<int>"), "doc"), "packed")
    size = packed.agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("terms")).first()
    out = f"query {q.schema['query'].dataType.simpleString()}, doc {kind}, score double, rank int"
    if not size.docs or not len(words):
        return spark.createDataFrame([], out)
    often = packed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(words))
    df[often.column("term").to_numpy()] = often.column("df").to_numpy()
    average = max(1, size.terms) / size.docs  # without terms there are no postings
    norm = lambda length: k1 * (1 - b + b * length / average)
    idf = np.log(1 + (size.docs - df + 0.5) / (df + 0.5))
    return q.repartition(n).mapInArrow(bm25.searcher(words, sorted(packed.inputFiles()), idf, norm, k1, top_k), out)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties by doc.  The group limit works before the shuffle."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
