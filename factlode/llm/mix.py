"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.llm.encode import RANK_FILE, count_tokens
from factlode.runtime import materialise

#: Documents of a source are laid out by size class (eighths of a power of two) and hashed strands: SPREAD, or as many as it takes that one holds
#: about STRAND_ROWS documents.  So no task holds more than a strand of one class, and the order follows size, which keeps the reached totals close.
SPREAD, STRAND_ROWS = 16, 500_000
SEED = 20260731


def source_label(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by one underscore; blank is null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s\-_]+", "_")
    return F.when(plain != "", plain)


def _shares(sizes: DataFrame, targets: DataFrame, total: Column) -> DataFrame:
    """Tokens that each source is to give: weight times one common level, capped at max_repeats times its own size.
    The level is the lowest at which all sources together give the total, or all are at their caps."""
    cap = F.when(F.col("weight") > 0, F.col("size") * F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf")))).otherwise(F.lit(0.0))
    t = (
        targets.join(sizes, "source", "full_outer")
        .select("source", F.coalesce(F.greatest("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), "max_repeats", F.coalesce("size", F.lit(0)).cast("double").alias("size"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
        .withColumn("cap", F.when(F.col("size") > 0, cap).otherwise(F.lit(0.0)))
        .withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    )
    # one row per source: a handful of rows, ordered in one task
    order = Window.orderBy("full_at", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    t = t.withColumn("total", total).withColumn("level", F.when(F.sum("weight").over(rest) > 0, level))
    t = t.withColumn("at", F.first(F.when((F.col("weight") > 0) & (F.col("level") <= F.col("full_at")), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    give = F.when(F.col("weight") > 0, F.least("cap", F.coalesce(F.col("weight") * F.col("at"), F.col("cap")))).otherwise(F.lit(0.0))
    return t.withColumn("target_tokens", give).withColumn("rate", F.when(F.col("size") > 0, F.col("target_tokens") / F.col("size")).otherwise(F.lit(0.0)))


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rank_file: str = RANK_FILE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents drawn so that each source has its share of as many tokens as ``docs`` has: (drawn, shares).

    targets: source, weight (share of the total; null or negative counts as 0), max_repeats (null: no cap).

    drawn: one row per use of a document: ``id_col``, source, copy (from 1), n_tokens.  Every document of a source is expected
    equally often (rate = tokens wanted / tokens there, at most max_repeats).  In the order of size, expected uses
    are summed up from one random offset; a document is used once per whole number that the sum crosses.
    shares: one row per source named in ``targets`` or found in ``docs``: weight, max_repeats, docs, tokens, target_tokens, capped,
    used_docs, copies, used_tokens, share.

    What a source at its cap cannot give, the others give in proportion to their weights, so that the total stays.
    A source without documents gives nothing; so do documents whose source is null, blank or not in ``targets`` (weight 0 in shares).
    Spellings of one source count as one.  Null and empty texts have 0 tokens and are drawn like others.
    Repeated rows are documents of their own.  Empty ``docs`` or ``targets``: nothing is drawn.
    """
    d = docs.select(F.col(id_col).alias("id"), source_label(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    h = F.xxhash64(F.col("id"), F.lit(seed))
    sized = count_tokens(d, "text", "n_tokens", rank_file)
    sized = materialise(sized.withColumn("class", F.floor(F.log2(F.col("n_tokens") + 1) * 8).cast("int")), "sized")
    strands = sized.where("source is not null").groupBy("source", "class").agg(F.greatest(F.lit(SPREAD), F.ceil(F.count(F.lit(1)) / STRAND_ROWS)).cast("int").alias("strands"))
    sized = sized.join(strands, ["source", "class"], "left").withColumn("strand", F.pmod(h, F.coalesce("strands", F.lit(SPREAD))).cast("int")).drop("strands")
    cells = materialise(sized.groupBy("source", "class", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")), "cells")
    wanted = targets.select(source_label(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("long").alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    sizes = cells.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("size"), F.sum("n").alias("n_docs"))
    everything = float(cells.agg(F.sum("tokens")).first()[0] or 0)  # one number
    rates = materialise(_shares(sizes, wanted, F.lit(everything)), "rates")
    run = Window.partitionBy("source").orderBy("class", "strand").rowsBetween(Window.unboundedPreceding, -1)
    at = cells.where("source is not null").withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).join(rates.where("rate > 0").select("source", "rate"), "source").select("source", "class", "strand", "before", "rate")
    within = Window.partitionBy("source", "class", "strand").orderBy("n_tokens", h, "id")
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    i = F.col("before") + F.row_number().over(within)
    crossed = lambda k: F.floor(F.col("rate") * k + offset)
    counted = sized.join(at, ["source", "class", "strand"]).withColumn("copies", (crossed(i) - crossed(i - 1)).cast("int")).where("copies > 0").select("id", "source", "n_tokens", "copies")
    counted = materialise(counted, "drawn")
    drawn = counted.select(F.col("id").alias(id_col), "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")
    used = counted.groupBy("source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shares = rates.join(used, "source", "left").select(
        "source", "weight", "max_repeats", F.col("n_docs").cast("long").alias("docs"), F.col("size").cast("long").alias("tokens"), "target_tokens", ((F.col("target_tokens") >= F.col("cap")) & (F.col("weight") > 0) & (F.col("size") > 0)).alias("capped"), zero("used_docs"), zero("copies"), zero("used_tokens"),
    )
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # a handful of rows
    return drawn, shares.withColumn("share", F.when(total > 0, F.col("used_tokens") / total).otherwise(F.lit(0.0)))
