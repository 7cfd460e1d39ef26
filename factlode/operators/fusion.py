"""Rank fusion, scope, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RRF_K = 60


def fuse(rankings: DataFrame, query: str, item: str, source: str, pos: str, k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: query, item, score, rank.

    An item that a source lists twice counts by its first place, and does not push later ones back.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    r = rankings.select(F.col(query).alias("query"), F.col(item).alias("item"), F.col(source).alias("source"), F.col(pos).alias("pos")).where("query is not null and item is not null and source is not null and pos is not null")
    first = r.groupBy("query", "source", "item").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("query", "source").orderBy("pos", "item"))
    fused = first.withColumn("place", place).groupBy("query", "item").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("score"), F.count(F.lit(1)).cast("int").alias("sources"))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def evidence_hits(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits (query, rank, doc, pages) that cover a target (query, doc, page): one row per hit and target."""
    h = hits.select("query", "rank", "doc", F.explode("pages").alias("page"))
    return h.join(targets, ["query", "doc", "page"]).select("query", "rank", "doc", "page").distinct()


def retrieval_metrics(hits: DataFrame, targets: DataFrame, recall_at: int = 5, mrr_at: int = 10, coverage_at: int = 5) -> DataFrame:
    """Per query of ``targets``: recall, reciprocal rank, covered and wanted targets, complete and cross-page coverage.

    crosses pages only where at least two pages are wanted, else null.
    """
    met = evidence_hits(hits, targets)
    per = met.groupBy("query").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= coverage_at, F.struct("doc", "page"))).alias("covered"))
    wanted = targets.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count_distinct("page").alias("pages"))
    j = wanted.join(per, "query", "left")
    covered = F.coalesce("covered", F.lit(0))
    return j.select(
        "query", (F.coalesce("first", F.lit(1 << 30)) <= recall_at).alias("recall"), F.when(F.col("first") <= mrr_at, F.round(1.0 / F.col("first"), 9)).otherwise(F.lit(0.0)).alias("reciprocal_rank"),
        covered.alias("covered"), "wanted", (covered == F.col("wanted")).alias("complete"), F.when(F.col("pages") >= 2, covered == F.col("wanted")).alias("crosses_pages"),
    )


def within_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (query, rank, chars) that are read under a budget of characters: those before which less than it is spent."""
    spent = F.sum("chars").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return hits.withColumn("spent_before", F.coalesce(spent, F.lit(0))).where(F.col("spent_before") < budget)
