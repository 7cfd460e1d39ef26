"""Prompts and the answers that follow their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The labels of the four lines, and of a chart's three.
LABELS = {"answer": "答案", "unit": "單位", "period": "期間", "evidence": "依據"}


def _line(c: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(c, rf"(?m)^\s*{label}\s*[：:]\s*(.*?)\s*$", 1))


def parse_answer(c: Column) -> Column:
    """The answer lines of a reply: answer (the whole text where no line is labelled), unit, period, citations (numbers in brackets); 無 and blank are null."""
    none = lambda x: F.when(~x.isin("", "無", "無。"), x)
    said = _line(c, LABELS["answer"])
    cites = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"[\[［]([0-9]{1,3})[\]］]"), F.lit(1)), lambda x: x.cast("int")))
    return F.struct(F.when(said != "", said).otherwise(F.trim(c)).alias("answer"), none(_line(c, LABELS["unit"])).alias("unit"), none(_line(c, LABELS["period"])).alias("period"), cites.alias("citations"))


def build_prompts(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """One prompt per question: its passages (query, rank, doc_id, pages, text) numbered in order, then the question.

    Gathers the passages of a question only, which the ranking before has limited."""
    head = F.format_string("[%d] %s p%s\n%s", F.row_number().over(Window.partitionBy("query").orderBy("rank")), "doc_id", F.array_join("pages", ","), F.coalesce("text", F.lit("")))
    p = passages.withColumn("part", F.struct("rank", head.alias("text"))).groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x.text), "\n\n").alias("passages"))
    ask = F.format_string("%s\n\n問題：%s\n請依下列格式回答：\n答案：\n單位：\n期間：\n依據：", F.coalesce("passages", F.lit("")), "question")
    return questions.join(p, "query", "left").select("query", ask.alias("prompt"))


def valid_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """The passages that citations name (query, citations; hits: query, rank, doc_id, pages): query, citation, doc_id, valid."""
    c = answers.select("query", F.explode_outer("citations").alias("citation")).where("citation is not null")
    j = c.join(hits.select("query", F.col("rank").alias("citation"), "doc_id", "pages"), ["query", "citation"], "left")
    return j.select("query", "citation", "doc_id", "pages", F.col("doc_id").isNotNull().alias("valid"))


def rerank(hits: DataFrame, scored: Column, top_k: int = 5) -> DataFrame:
    """Hits (query, rank, ...) by a new score that replaces the old: ties keep the order they came in."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "before")
    return hits.withColumnRenamed("rank", "before").withColumn("score", scored).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
