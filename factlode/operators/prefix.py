"""Running sums within groups of any size: groups too large for one task are cut into ranges of their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from factlode.runtime import materialise, temp_name

#: Rows of a group beyond which it is cut, and the least number of ranges that all such groups are cut into.
HOT_ROWS, RANGES = 1_000_000, 256


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], hot_rows: int = HOT_ROWS, ranges: int = RANGES, upto: bool = True) -> DataFrame:
    """``df`` with running sums: ``sums`` names new columns by the column that each adds up.

    order: column names, ascending, nulls first.  Rows of equal order follow each other as they come, so order should be
    total.  upto: a row's own value counts.

    Groups of more than ``hot_rows`` rows are cut into ranges of their whole order, so that ties of its first columns may part; each
    range is summed apart and the sums of the ranges before are added.  Nulls add nothing.  No rows: no rows.
    """
    end = Window.currentRow if upto else -1
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot_rows)
    hot = materialise(sizes.withColumnsRenamed({"rows": temp_name(group, "rows")}), "hot")
    count = hot.columns[-1]
    sum_over = lambda w: {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}
    whole = sum_over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    many = hot.agg(F.sum(count)).first()[0]
    if not many:
        return df.select("*", *[c.alias(n) for n, c in whole.items()])
    taken = df.columns
    own = [temp_name(taken, f"group_{i}") for i in range(len(group))]
    rename = lambda t: t.select(*[F.col(g).alias(o) for g, o in zip(group, own)], *[c for c in t.columns if c not in group])
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(o)) for g, o in zip(group, own)])
    rng, at = temp_name(taken, "range"), temp_name(taken, "at_range")
    parts = [temp_name(taken, f"sum_{i}") for i in range(len(sums))]
    cut = rename(hot.drop(count))
    laid = df.join(cut, same, "left_semi").repartitionByRange(max(ranges, -(-4 * many // hot_rows)), *group, *order)
    marked = materialise(laid.withColumn(rng, F.spark_partition_id()), "ranged")  # ranges come from a sample, so they are fixed once
    totals = marked.groupBy(*group, rng).agg(*[F.sum(c).alias(p) for c, p in zip(sums.values(), parts)])
    before = Window.partitionBy(*group).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    totals = rename(totals.select(*group, F.col(rng).alias(at), *[F.coalesce(F.sum(p).over(before), F.lit(0)).alias(p) for p in parts]))
    within = sum_over(Window.partitionBy(*group, rng).orderBy(*order).rowsBetween(Window.unboundedPreceding, end))
    joined = marked.join(totals, same & (F.col(rng) == F.col(at))).select(*taken, *[(c + F.col(p)).alias(n) for (n, c), p in zip(within.items(), parts)])
    usual = df.join(cut, same, "left_anti").select("*", *[c.alias(n) for n, c in whole.items()])
    return usual.unionByName(joined)
