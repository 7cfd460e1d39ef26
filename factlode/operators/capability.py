"""What a filing can be asked about, and which filings can serve each type of question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Least legible pages, tables, tables with a unit, and labelled charts.
PAGES, TABLES, WITH_UNIT, CHARTS = 10, 3, 5, 2
#: Verdicts after which nothing that was extracted counts.
BLOCKING = ["unusable_text_layer", "partially_unusable_text_layer", "too_short"]


def capability(counts: DataFrame) -> DataFrame:
    """``counts`` (doc_id, verdict, legible_pages, tables, tables_with_unit, labelled_charts) with sources: the question types it can serve, in order; none behind a blocking verdict."""
    prose, some = F.col("legible_pages") >= PAGES, F.col("tables") >= TABLES
    units = some & (F.col("tables_with_unit") >= WITH_UNIT)
    kinds = {"chart_value_trend": F.col("labelled_charts") >= CHARTS, "cross_document": prose & some, "cross_page": prose, "cross_period_comparison": units, "narrative_fact": prose, "numeric_calculation": units, "table_cell": some}
    sources = F.array_compact(F.array(*[F.when(c, k) for k, c in kinds.items()]))
    return counts.withColumn("sources", F.when(F.coalesce(F.col("verdict").isin(BLOCKING), F.lit(False)), F.array().cast("array<string>")).otherwise(sources))


def coverage(capabilities: DataFrame) -> DataFrame:
    """question_type and the number of documents that can serve it, with the first and last of them."""
    return capabilities.select("doc_id", F.explode("sources").alias("question_type")).groupBy("question_type").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
