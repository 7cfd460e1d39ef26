"""Checks as rows: every rule that a record breaks is a problem, and nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Closed vocabularies of the question set.
TYPES = ["narrative_fact", "table_cell", "numeric_calculation", "cross_period_comparison", "chart_value_trend", "cross_page", "cross_document", "unanswerable"]
REFUSALS = ["absent_from_documents", "outside_selected_scope", "irreconcilable_conflict"]
KINDS = ["page", "table_cell", "chart_crop", "sql_row"]
PERIOD = "^FY[0-9]{4}(Q[1-4])?(-FY[0-9]{4}(Q[1-4])?)?$"


def gold_problems(gold: DataFrame) -> DataFrame:
    """question_id and each rule it breaks."""
    rule = lambda broken, name: F.when(F.coalesce(broken, F.lit(True)), F.lit(name))
    answerable = F.col("answerable")
    evidence = F.coalesce("required_evidence", F.array().cast(gold.schema["required_evidence"].dataType))
    rules = F.array_compact(F.array(
        rule(~F.col("question_type").isin(TYPES), "unknown_type"),
        rule(F.length(F.trim(F.coalesce("question", F.lit("")))) == 0, "no_question"),
        rule(F.coalesce(answerable & F.col("answer").isNull(), F.lit(False)), "answer_missing"),
        rule(F.coalesce(~answerable & F.col("answer").isNotNull(), F.lit(False)), "answer_of_unanswerable"),
        rule(F.coalesce(~answerable & ~F.coalesce(F.col("refusal_reason_class").isin(REFUSALS), F.lit(False)), F.lit(False)), "refusal_class_missing"),
        rule(F.coalesce(answerable & F.col("refusal_reason_class").isNotNull(), F.lit(False)), "refusal_class_of_answerable"),
        rule(F.col("period").isNull() | ~F.col("period").rlike(PERIOD), "period"),
        rule(F.coalesce(answerable & (F.size(F.coalesce("source_document", F.array().cast("array<string>"))) == 0), F.lit(False)), "no_source_document"),
        rule(F.coalesce(answerable & (F.size(F.coalesce("page_numbers", F.array().cast("array<int>"))) == 0), F.lit(False)), "no_page"),
        rule(F.exists(F.coalesce("page_numbers", F.array().cast("array<int>")), lambda p: p < 1), "page_below_one"),
        rule(F.exists(evidence, lambda e: ~e.kind.isin(KINDS)), "evidence_kind"),
        rule(F.exists(evidence, lambda e: ~e.ref.rlike("^[^#]+#p[0-9]+(/.*)?$")), "evidence_reference"),
        rule(F.coalesce(F.col("tolerance.value") <= 0, F.lit(False)), "tolerance"),
        rule(F.coalesce(F.size("derived_from") == 1, F.lit(False)), "derived_from_one"),
    ))
    return gold.select("question_id", F.explode(F.array_distinct(rules)).alias("problem")).distinct()


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def coverage(claimed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``key`` and side (missing: claimed, not held; extra: held, not claimed)."""
    a, b = claimed.select(key).where(F.col(key).isNotNull()).distinct(), held.select(key).where(F.col(key).isNotNull()).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def digest_changes(locked: DataFrame, found: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """A lock against what is there: OK, CHANGED, ADDED or MISSING for every key."""
    a, b = locked.select(key, F.col(digest).alias("was")), found.select(key, F.col(digest).alias("now"))
    j = a.join(b, key, "full_outer")
    status = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "MISSING").when(F.col("was") == F.col("now"), "OK").otherwise("CHANGED")
    return j.select(key, status.alias("status"))


def row_digest(*cols: Column) -> Column:
    """A digest that no shifting of text between columns leaves equal: each value with its length before it."""
    part = lambda c: F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in cols]), 256)
