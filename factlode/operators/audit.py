"""Samples for audit, leakage between question sets, and citations graded against evidence."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, functions as F

from factlode.functions.keys import company_code, filing_id
from factlode.operators.prefix import running_sums
from factlode.operators.similarity import similar_texts
from factlode.runtime import materialise

#: Seed and size of the audit sample, and the type that is always in it.
SEED, SIZE, ALWAYS = 20260731, 8, "chart_value_trend"


def audit_sample(gold: DataFrame, seed: int = SEED, size: int = SIZE, always: str = ALWAYS) -> DataFrame:
    """The audit sample (question_id, why): all questions of one type, and ``size`` of the rest, drawn by place in the order of their ids.

    Places, not ids, reach the driver: a Mersenne Twister draws them from the count alone.  Fewer questions than ``size``: all.
    """
    q = gold.select("question_id", "question_type").where("question_id is not null").dropDuplicates(["question_id"])
    rest = q.where(~F.coalesce(F.col("question_type") == always, F.lit(False)))
    n = rest.count()
    places = random.Random(seed).sample(range(n), min(size, n))
    ordered = running_sums(rest.select("question_id", F.lit(0).alias("all"), F.lit(1).alias("one")), ["all"], ["question_id"], {"place": "one"})
    drawn = ordered.where((F.col("place") - 1).isin(places)).select("question_id", F.lit("sampled").alias("why"))
    return drawn.unionAll(q.where(F.col("question_type") == always).select("question_id", F.lit("always").alias("why")))


def leakage(gold: DataFrame, training: tuple[str, ...] = ("dev", "challenger"), threshold: float = 0.8) -> DataFrame:
    """What the two sides of the question sets share: kind (company, document, question) and key.

    Companies and documents by their one spelling; questions where the bigram sets of two wordings are at least ``threshold`` alike (key: both classes).
    """
    g = gold.withColumn("side", F.when(F.col("question_set").isin(*training), 1).otherwise(2))
    both = lambda df, kind: df.where("key is not null").groupBy("key").agg(F.count_distinct("side").alias("n")).where("n = 2").select(F.lit(kind).alias("kind"), "key")
    firms = both(g.select("side", company_code(F.col("company.code")).alias("key")), "company")
    docs = both(g.select("side", F.explode(F.transform("source_document", filing_id)).alias("key")), "document")
    q = g.select("question_id", "question", "side").dropDuplicates(["question_id"])
    pairs, members = similar_texts(q, "question_id", "question", threshold)
    # read three times: written once, so that the texts are cut and shuffled once
    sides = materialise(members.join(q, members.id == q.question_id).groupBy("class").agg(F.collect_set("side").alias("sides")), "sides")
    same = sides.where(F.size("sides") == 2).select(F.lit("question").alias("kind"), F.col("class").alias("key"))
    s = lambda i: sides.select(F.col("class").alias(f"class_{i}"), F.col("sides").alias(f"s{i}"))
    near = pairs.join(s(1), "class_1").join(s(2), "class_2").where(F.size(F.array_union("s1", "s2")) == 2)
    return firms.unionAll(docs).unionAll(same).unionAll(near.select(F.lit("question").alias("kind"), F.concat_ws("|", "class_1", "class_2").alias("key")))


def grade_citations(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether an answer's citations meet its evidence: query, cited, met, valid.

    citations: query, doc_id, page, row, column (null for passages), refused; evidence: query, kind, doc_id, page, row, column.  A page is met by a passage of
    that page, a row or cell by the same place in the structured source (columns may contain one another).  A refusal has no verdict (null);
    an answer that cites nothing, or nothing of its evidence, is not valid.
    """
    c = citations.select("query", F.col("doc_id").alias("cd"), F.col("page").alias("cp"), F.col("row").alias("cr"), F.col("column").alias("cc"), "refused")
    per = c.groupBy("query").agg(F.count("cd").alias("cited"), F.bool_or("refused").alias("refused"))
    j = c.join(evidence, "query").where(F.col("cd") == F.col("doc_id"))
    inside = F.contains("cc", F.col("column")) | F.contains(F.col("column"), F.col("cc"))
    hit = (F.col("cp") == F.col("page")) & (F.col("kind").isin("page", "chart_crop") | (F.col("row").isNull()) | ((F.col("cr") == F.col("row")) & F.coalesce(inside, F.lit(True))))
    met = j.where(hit).groupBy("query").agg(F.count_distinct(F.struct("kind", "doc_id", "page", "row", "column")).alias("met"))
    return per.join(met, "query", "left").select("query", "cited", F.coalesce("met", F.lit(0)).alias("met"), F.when(~F.coalesce("refused", F.lit(False)), F.coalesce("met", F.lit(0)) > 0).alias("valid"))
