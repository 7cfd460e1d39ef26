"""Rates with their denominators, gates and the recomputation of a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from factlode.functions.stats import mcnemar, wilson

#: Thresholds of the gates.
LIMITS = {"pooled_gain": 15.0, "single_gain": 10.0, "regression": 5.0, "citation": 0.90, "numeric_route": 0.90, "route": 0.85, "over_answer": 0.25, "refusal_precision": 0.80, "probe_refusals": 4, "retrieval_p95": 3.0, "generation_p95": 60.0, "memory_gb": 22.0}


def proportions(records: DataFrame, by: list[str], hit: str, scope: str = "true") -> DataFrame:
    """Per group: n in scope, k that hit, rate and the Wilson interval; a rate without a denominator is null."""
    g = records.groupBy(*by).agg(F.count_if(F.expr(scope)).alias("n"), F.count_if(F.expr(scope) & F.coalesce(F.expr(hit), F.lit(False))).alias("k"))
    lo, hi = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select(*by, "n", "k", F.when(F.col("n") > 0, F.round(F.col("k") / F.col("n"), 6)).alias("rate"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def paired_test(outcomes: DataFrame, item: str, system: str, baseline: str, candidate: str, correct: str) -> DataFrame:
    """The exact paired test of two systems over the items both have: n, gained, lost, p."""
    p = outcomes.where(F.col(system).isin(baseline, candidate)).groupBy(item).pivot(system, [baseline, candidate]).agg(F.max(correct))
    p = p.where(F.col(f"`{baseline}`").isNotNull() & F.col(f"`{candidate}`").isNotNull())
    c = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col(f"`{baseline}`") & F.col(f"`{candidate}`")).alias("gained"), F.count_if(F.col(f"`{baseline}`") & ~F.col(f"`{candidate}`")).alias("lost"))
    return c.select(F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"), "n", "gained", "lost", F.round(mcnemar(F.col("gained"), F.col("lost")), 9).alias("p"))


def decide(summary: DataFrame) -> DataFrame:
    """Gates over one-row inputs (metric, value): gate, passed, decision.  An input that is missing fails its gate.

    metrics: data_reproducible, results_reproducible (1 or 0), pooled_gain, single_gain, regression, citation, numeric_route, route, over_answer,
    refusal_precision, probe_refusals, retrieval_p95, generation_p95, memory_gb.  Only the tenth gate is soft.
    """
    m = summary.groupBy().pivot("metric", sorted({*LIMITS, "data_reproducible", "results_reproducible"})).agg(F.max("value"))
    least = lambda c: F.coalesce(F.col(c) >= LIMITS[c], F.lit(False))
    most = lambda c: F.coalesce(F.col(c) <= LIMITS[c], F.lit(False))
    rules = {
        "G1": F.coalesce(F.col("data_reproducible") == 1, F.lit(False)), "G2": least("pooled_gain") & least("single_gain"), "G3": most("regression"), "G4": least("citation"), "G5": least("numeric_route"), "G6": least("route"),
        "G7": most("over_answer") & least("refusal_precision"), "G8": least("probe_refusals"), "G9": F.coalesce(F.col("results_reproducible") == 1, F.lit(False)), "G10": most("retrieval_p95") & most("generation_p95") & most("memory_gb"),
    }
    each = m.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), r.alias("passed"), F.lit(i).alias("place")) for i, (g, r) in enumerate(rules.items())])).alias("x")).select("x.*")
    verdict = each.agg(F.when(F.count_if(~F.col("passed") & (F.col("gate") != "G10")) > 0, "NO_GO").when(F.count_if(~F.col("passed")) > 0, "CONDITIONAL_GO").otherwise("GO").alias("decision"))
    return each.crossJoin(F.broadcast(verdict)).select("gate", "passed", "decision")  # one row on the right


def verify(claimed: DataFrame, recomputed: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    """Problems between claimed and recomputed counts and rates (keys, n, k, rate): missing, unsupported, or another number."""
    a, b = claimed.select(*keys, F.struct("n", "k", F.round("rate", places).alias("rate")).alias("claimed")), recomputed.select(*keys, F.struct("n", "k", F.round("rate", places).alias("rate")).alias("recomputed"))
    j = a.join(b, keys, "full_outer")
    kind = F.when(F.col("claimed").isNull(), "missing").when(F.col("recomputed").isNull(), "unsupported").when(~F.col("claimed").eqNullSafe(F.col("recomputed")), "mismatch")
    return j.select(*keys, kind.alias("kind"), "claimed", "recomputed").where("kind is not null")


def pooled_gain(records: DataFrame, system: str, category: str, categories: list[str], correct: str, baseline: str, candidate: str) -> DataFrame:
    """One row, gain: percentage points of the candidate over the baseline, items of all ``categories`` pooled; null where either lacks a category."""
    of = lambda s: (F.col(system) == s) & F.col(category).isin(categories)
    rate = lambda s: F.when(F.count_distinct(F.when(of(s), F.col(category))) == len(set(categories)), 100.0 * F.count_if(of(s) & F.coalesce(correct, F.lit(False))) / F.count_if(of(s)))
    return records.agg((rate(candidate) - rate(baseline)).alias("gain"))


def refusal_rates(scores: DataFrame) -> DataFrame:
    """One row over scores (refused, should_refuse): refused, should_refuse, correct_refusals, precision, recall; a rate without a denominator is 0."""
    n = scores.agg(F.count_if("refused").alias("refused"), F.count_if("should_refuse").alias("should_refuse"), F.count_if(F.col("refused") & F.col("should_refuse")).alias("correct_refusals"))
    part = lambda of: F.when(F.col(of) > 0, F.round(F.col("correct_refusals") / F.col(of), 4)).otherwise(0.0)
    return n.select("*", part("refused").alias("precision"), part("should_refuse").alias("recall"))


def falls(rows: DataFrame, series: list[str], cutoff: str, correct: str) -> DataFrame:
    """Where ``correct`` falls from one cutoff of a series to the next: series, before, cutoff, correct_before, correct."""
    w = Window.partitionBy(*series).orderBy(cutoff)
    r = rows.select(*series, F.lag(cutoff).over(w).alias("before"), F.col(cutoff).alias("cutoff"), F.lag(correct).over(w).alias("correct_before"), F.col(correct).alias("correct"))
    return r.where("correct < correct_before")


def pairwise_tests(outcomes: DataFrame, item: str, system: str, correct: str) -> DataFrame:
    """Every two systems over the items that both have: left, right, n, only_left, only_right, p, and whether p lies below 0.05 shared out over all pairs."""
    o = outcomes.groupBy(item, system).agg(F.max(correct).alias("ok"))
    a, b = o.select(item, F.col(system).alias("left"), F.col("ok").alias("ok_l")), o.select(item, F.col(system).alias("right"), F.col("ok").alias("ok_r"))
    g = a.join(b, item).where(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok_l") & ~F.col("ok_r")).alias("only_left"), F.count_if(~F.col("ok_l") & F.col("ok_r")).alias("only_right"))
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # one row per pair of systems
    g = g.withColumn("p", F.round(mcnemar(F.col("only_right"), F.col("only_left")), 9))
    return g.withColumn("significant", F.col("p") < 0.05 / tests)
