"""Which companies a question names, and retrieval kept to their documents before anything is ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _substrings(c: Column, size: int) -> Column:
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(c, i, F.lit(size))))


def company_scope(questions: DataFrame, names: DataFrame) -> DataFrame:
    """question_id, codes: the companies that a question names (by name or alias, or by a code between no other digits), in order.

    questions: question_id, question; names: code, name (any number of names of a code, not unique).  A question that names none has
    null codes, which is not an empty scope: it is not restricted.

    Substrings of the lengths that names have meet the names on equality; no question is held against every name.
    """
    n = names.select("code", "name").where("code is not null").distinct()
    sizes = sorted(r[0] for r in n.where("length(name) > 0").select(F.length("name")).distinct().collect())  # distinct lengths: no more than the longest name has characters
    q = questions.select("question_id", "question").where("question_id is not null and question is not null")
    parts = [_substrings(F.col("question"), k) for k in sizes]
    codes = F.regexp_extract_all("question", F.lit("(?<![0-9])([0-9]+)(?![0-9])"), F.lit(1))
    empty = F.array().cast("array<string>")
    said = q.select("question_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(p, empty) for p in [*parts, codes]])))).alias("said"))
    known = n.select("code", F.col("name").alias("said")).unionAll(n.select("code", F.col("code").alias("said"))).where("said is not null").distinct()
    found = said.join(known, "said").groupBy("question_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return questions.select("question_id").where("question_id is not null").distinct().join(found, "question_id", "left")


def within_scope(hits: DataFrame, scopes: DataFrame, documents: DataFrame, query: str = "query", doc: str = "doc_id") -> DataFrame:
    """``hits`` whose document belongs to a company that the question names; questions without a scope keep all.

    scopes: ``query``, codes; documents: ``doc``, code.  To be applied before top-k and fusion.
    """
    allowed = scopes.where("codes is not null").select(query, F.explode("codes").alias("code")).join(documents.select(doc, "code"), "code").select(query, doc).distinct()
    free = hits.join(scopes.where("codes is not null").select(query), query, "left_anti")
    return hits.join(allowed, [query, doc], "left_semi").unionByName(free)
