"""The fact table and its closed set of query templates; refusals are rows with a status, never guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.functions.keys import fold_width
from factlode.operators.prefix import HOT_ROWS, running_sums
from factlode.runtime import materialise, temp_name

#: The identity of a fact; its source is a part of it.
KEY = ["company_code", "period", "statement", "basis", "account", "source_kind", "source_ref"]
POINT = ["company_code", "account", "period", "basis"]
#: Unit spellings that mean another.
ALIASES = {"仟元": "千元", "仟股": "千股", "百萬": "百萬元", "億": "億元", "萬": "萬元", "千": "千元"}
#: 元 per unit.
SCALES = {"元": 1, "千元": 1000, "萬元": 10000, "百萬元": 1000000, "億元": 100000000, "十億元": 1000000000}


def _lookup(pairs: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def canonical_unit(c: Column) -> Column:
    """One spelling of a unit; blank is null."""
    t = F.trim(fold_width(c))
    return F.when(t != "", F.coalesce(_lookup(ALIASES, t), t))


def to_base(value: Column, unit: Column) -> Column:
    """An amount in 元; null where the unit is unknown or not stated."""
    return F.try_multiply(value, _lookup(SCALES, canonical_unit(unit)).cast("decimal(12,0)")).try_cast("decimal(38,6)")


def convert(value: Column, unit: Column, to: Column) -> Column:
    """An amount in another unit; null where either is unknown."""
    return F.try_divide(to_base(value, unit), _lookup(SCALES, canonical_unit(to)).cast("decimal(12,0)")).try_cast("decimal(38,6)")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of one key the last by ``order`` (an upsert).  Keys compare nulls as equal; one grouping, no sort of the whole."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return kept.select(*[F.col("r")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def usable() -> Column:
    """Whether a figure may be computed with: value there, unit stated and uniform."""
    return F.col("value").isNotNull() & F.col("unit").isNotNull() & F.col("unit_is_uniform")


def citation() -> Column:
    return F.format_string("%s %s %s [%s:%s]", "company_code", "period", "account", "source_kind", "source_ref")


def exactly_one(facts: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """For each point of ``wanted``: its figure if the store holds exactly one, else the status that says why not.

    OK, AMBIGUOUS, NO_COMPANY, NO_ACCOUNT (the company has no such account at all), NO_PERIOD.
    """
    got = facts.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.max("unit").alias("unit"))
    accounts = facts.select("company_code", "account", F.lit(True).alias("has_account")).distinct()
    firms = known.select(F.col("code").alias("company_code"), F.lit(True).alias("has_company")).distinct()
    j = wanted.select(*POINT).distinct().join(got, POINT, "left").join(accounts, ["company_code", "account"], "left").join(firms, "company_code", "left")
    status = F.when(F.col("n") == 1, "OK").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("has_company").isNull(), "NO_COMPANY").when(F.col("has_account").isNull(), "NO_ACCOUNT").otherwise("NO_PERIOD")
    one = F.col("n") == 1
    return j.select(*POINT, status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.when(one, F.col("value")).alias("value"), F.when(one, F.col("unit")).alias("unit"))


def _single(facts: DataFrame) -> DataFrame:
    """Facts that are the only one of their point."""
    cols = ["value", "unit", "currency", "unit_is_uniform"]
    one = facts.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in cols]).where("n = 1")
    return one.drop("n")


def refusal(a: str, b: str) -> Column:
    """The first rule of comparability that two figures break, null if none: both values, uniform units, units stated, one currency, one scale."""
    x = lambda c: F.col(f"{a}.{c}")
    y = lambda c: F.col(f"{b}.{c}")
    same = canonical_unit(x("unit")) == canonical_unit(y("unit"))
    return (
        F.when(x("value").isNull() | y("value").isNull(), "no_value").when(~x("unit_is_uniform") | ~y("unit_is_uniform"), "unit_not_uniform")
        .when(canonical_unit(x("unit")).isNull() | canonical_unit(y("unit")).isNull(), "no_unit").when(~x("currency").eqNullSafe(y("currency")), "currency").when(~same, "scale")
    )


def percent(n: Column, d: Column) -> Column:
    """100 n / d to two places, half up; multiplied first, so that no digit is lost."""
    n, d = n.cast("decimal(24,6)"), d.cast("decimal(24,6)")
    return F.round(F.try_divide(n * F.lit(100).cast("decimal(3,0)"), d), 2).cast("decimal(24,2)")


def year_changes(facts: DataFrame) -> DataFrame:
    """Each annual figure against the year before: delta, growth in percent, status (OK or the rule it breaks; ``zero_base`` refuses growth)."""
    one = _single(facts).where(F.col("period").rlike("^FY[0-9]{4}$")).withColumn("year", F.substring("period", 3, 4).cast("int"))
    a, b = one.alias("a"), one.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("company_code", "account", "basis")] + [F.col("a.year") == F.col("b.year") + 1]
    j = a.join(b, on)
    why = refusal("a", "b")
    delta = (F.col("a.value") - F.col("b.value")).cast("decimal(38,6)")
    zero = F.col("b.value") == 0
    return j.select(
        *[F.col(f"a.{c}") for c in POINT], F.coalesce(why, F.when(zero, "zero_base"), F.lit("OK")).alias("status"), F.when(why.isNull(), delta).alias("delta"), F.when(why.isNull() & ~zero, percent(delta, F.col("b.value"))).alias("growth"), F.when(why.isNull(), canonical_unit(F.col("a.unit"))).alias("unit"),
    )


def account_ratios(facts: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """One account as a percentage of another, per company, period and basis."""
    one = _single(facts)
    a, b = one.where(F.col("account") == numerator).alias("a"), one.where(F.col("account") == denominator).alias("b")
    j = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("company_code", "period", "basis")])
    why, zero = refusal("a", "b"), F.col("b.value") == 0
    return j.select(F.col("a.company_code"), F.col("a.period"), F.col("a.basis"), F.coalesce(why, F.when(zero, "zero_denominator"), F.lit("OK")).alias("status"), F.when(why.isNull() & ~zero, percent(F.col("a.value"), F.col("b.value"))).alias("ratio"))


def cross_source(facts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Whether the sources of a point agree: MISS with one record, else agrees where one unit is stated and the spread is within ``tolerance`` of the greatest size."""
    g = facts.groupBy(*POINT).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.count_distinct(canonical_unit(F.col("unit"))).alias("units"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max(F.abs("value")).alias("size"))
    spread = (F.col("hi") - F.col("lo")).cast("decimal(38,6)")
    ok = (F.col("with_value") >= 2) & (F.col("units") <= 1) & (spread <= F.col("size") * F.lit(tolerance).cast("decimal(6,3)"))
    return g.select(*POINT, "n", F.when(F.col("n") < 2, "MISS").when(ok, "AGREE").otherwise("DISAGREE").alias("verdict"), spread.alias("spread"))


def carry_forward(rows: DataFrame, group: str, order: list[str], col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fills ``col`` from the last row before that has one; inherited says where it did.

    order should be total.  In a group of more than ``hot_rows`` rows the values are numbered in their order (running sums over ranges of it), and every row
    takes the value of the number that it stands behind.
    """
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = lambda df: df.withColumn("inherited", F.col(col).isNull()).withColumn(col, F.last(col, ignorenulls=True).over(w))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    key, step, at, kept = (temp_name(rows.columns, n) for n in ("hot_group", "has_value", "value_number", "value_there"))
    hot = materialise(sizes.select(F.col(group).alias(key)), "hot")
    if hot.isEmpty():
        return filled(rows)
    same = F.col(group).eqNullSafe(F.col(key))
    many = running_sums(rows.join(hot, same, "left_semi").withColumn(step, F.col(col).isNotNull().cast("long")), [group], order, {at: step}, hot_rows)
    many = materialise(many, "numbered")
    values = many.where(F.col(step) == 1).select(F.col(group).alias(key), F.col(at).alias(f"{at}_"), F.col(col).alias(kept))
    got = many.join(values, same & (F.col(at) == F.col(f"{at}_")), "left").withColumn("inherited", F.col(col).isNull()).withColumn(col, F.coalesce(col, kept))
    return filled(rows.join(hot, same, "left_anti")).unionByName(got.select(*rows.columns, "inherited"))


def unpivot(rows: DataFrame, ids: list[str], columns: list[str], names: str = "account", values: str = "value") -> DataFrame:
    """Wide rows as one row per figure that is there."""
    return rows.unpivot(ids, columns, names, values).where(F.col(values).isNotNull())
