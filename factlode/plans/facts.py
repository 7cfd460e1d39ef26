"""Queries over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.operators import facts as O
from factlode.plans import sqltext as S
from factlode.runtime import load


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "fin_line_item")


def fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Facts of one identity as last loaded."""
    f = _facts(spark, d).select(*O.KEY, "value", "unit", "loaded_at", "line_id")
    return O.last_wins(f, O.KEY, ["loaded_at", "line_id"])


def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every point of the store and the same points a year on, looked up."""
    f = _facts(spark, d)
    points = f.select(*O.POINT)
    later = points.where(F.col("period").rlike("^FY[0-9]{4}")).withColumn("period", F.concat(F.lit("FY"), (F.substring("period", 3, 4).cast("int") + 1).cast("string"), F.substring("period", 7, 10)))
    return O.exactly_one(f, points.unionByName(later), load(spark, d, "company"))


def period_changes(spark: SparkSession, d: str) -> DataFrame:
    return O.year_changes(_facts(spark, d))


def account_ratio(spark: SparkSession, d: str) -> DataFrame:
    return O.account_ratios(_facts(spark, d), "負債總額", "資產總額")


def cross_source_check(spark: SparkSession, d: str) -> DataFrame:
    return O.cross_source(_facts(spark, d))


def conflict_rate(spark: SparkSession, d: str) -> DataFrame:
    """Points with several records, and of those the ones whose values differ, by basis."""
    g = _facts(spark, d).groupBy(*O.POINT).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))
    return g.groupBy("basis").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("values") > 1).alias("conflicting"))


def base_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in 元 and in 百萬元 where the unit is a known spelling."""
    f = _facts(spark, d)
    return f.select("line_id", O.canonical_unit(F.col("unit")).alias("unit"), O.to_base(F.col("value"), F.col("unit")).alias("base"), O.convert(F.col("value"), F.col("unit"), F.lit("百萬元")).alias("millions")).where("base is not null")


def account_periods(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("company_code").agg(F.count_distinct("account").alias("accounts"), F.count_distinct("period").alias("periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def fact_sources(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("source_kind", "source_url").agg(F.count(F.lit(1)).alias("rows"), F.max("loaded_at").alias("last_loaded"))


def usable_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).groupBy("source_kind", "statement").agg(F.count(F.lit(1)).alias("rows"), F.count_if(O.usable()).alias("usable"))


def fact_citations(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).where("statement = 'ratio'").select("line_id", O.citation().alias("citation"))


def unit_carry(spark: SparkSession, d: str) -> DataFrame:
    """The unit of each text row, taken on from the row before of its company where it states none."""
    f = _facts(spark, d).where("source_kind = 'extracted_text_row'").select("line_id", "company_code", F.when(F.trim("unit") != "", F.col("unit")).alias("unit"))
    return O.carry_forward(f, "company_code", ["line_id"], "unit")


def part_figures(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return O.unpivot(p, ["p_partkey"], ["p_size", "p_retailprice"])


def statement_cube(spark: SparkSession, d: str) -> DataFrame:
    """Rows and values by statement and basis, with all totals."""
    return _facts(spark, d).cube("statement", "basis").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"))


def company_industry(spark: SparkSession, d: str) -> DataFrame:
    """Companies of facts against the dimension: status OK, UNKNOWN (no dimension row) or UNUSED."""
    c = load(spark, d, "company").select(F.col("code").alias("company_code"), "industry_schema").distinct()
    f = _facts(spark, d).groupBy("company_code").agg(F.count(F.lit(1)).alias("rows"))
    j = f.join(c, "company_code", "full_outer")
    return j.select("company_code", F.coalesce("rows", F.lit(0)).alias("rows"), "industry_schema", F.when(F.col("rows").isNull(), "UNUSED").when(F.col("industry_schema").isNull(), "UNKNOWN").otherwise("OK").alias("status"))


QUERIES = {f.__name__: f for f in (fact_upsert, fact_lookup, period_changes, account_ratio, cross_source_check, conflict_rate, base_amounts, account_periods, fact_sources, usable_facts, fact_citations, unit_carry, part_figures, statement_cube, company_industry)}

_P = ", ".join(O.POINT)
_K = ", ".join(O.KEY)
_ONE = f"(select {_P}, any_value(value) value, any_value(unit) unit, any_value(currency) currency, any_value(unit_is_uniform) unit_is_uniform, max(value) mv, max(unit) mu, max(currency) mc, bool_and(unit_is_uniform) mf from fin_line_item group by {_P} having count(*) = 1)"
_CU = lambda c: S.canonical_unit(c)
_REFUSAL = f"case when a.mv is null or b.mv is null then 'no_value' when not a.mf or not b.mf then 'unit_not_uniform' when {_CU('a.mu')} is null or {_CU('b.mu')} is null then 'no_unit' when a.mc is distinct from b.mc then 'currency' when {_CU('a.mu')} <> {_CU('b.mu')} then 'scale' end"
_PCT = lambda n, d: f"cast(sign({n}) * sign({d}) * ((abs(cast({n} * 1000000 as hugeint)) * 20000 + abs(cast({d} * 1000000 as hugeint))) // (2 * abs(cast({d} * 1000000 as hugeint)))) as decimal(24, 0)) / 100"
_SCALE = lambda c: "case " + _CU(c) + " " + " ".join(f"when '{k}' then {v}" for k, v in O.SCALES.items()) + " end"
SQL = {
    "fact_upsert": f"select {_K}, value, unit, loaded_at, line_id from (select *, row_number() over (partition by {_K} order by loaded_at desc, line_id desc) k from fin_line_item) where k = 1",
    "fact_lookup": f"""with p as (select {_P} from fin_line_item union select company_code, account, 'FY' || (cast(substring(period, 3, 4) as integer) + 1) || substring(period, 7), basis from fin_line_item where regexp_matches(period, '^FY[0-9]{{4}}')),
g as (select {_P}, count(*) n, max(value) value, max(unit) unit from fin_line_item group by {_P}) select p.*, case when n = 1 then 'OK' when n > 1 then 'AMBIGUOUS' when not exists (select 1 from company c where c.code = p.company_code) then 'NO_COMPANY' when not exists (select 1 from fin_line_item f where f.company_code = p.company_code and f.account = p.account) then 'NO_ACCOUNT' else 'NO_PERIOD' end status,
coalesce(n, 0) n, case when n = 1 then value end "value", case when n = 1 then unit end unit from p left join g using ({_P})""",
    "period_changes": f"""with o as {_ONE}, y as (select *, cast(substring(period, 3, 4) as integer) yr from o where regexp_matches(period, '^FY[0-9]{{4}}$')), j as (select a.company_code, a.account, a.period, a.basis, {_REFUSAL} why, a.mv av, b.mv bv, {_CU('a.mu')} u from y a join y b on a.company_code = b.company_code and a.account = b.account and a.basis = b.basis and a.yr = b.yr + 1)
select {_P}, coalesce(why, case when bv = 0 then 'zero_base' end, 'OK') status, case when why is null then av - bv end delta, case when why is null and bv <> 0 then {_PCT('(av - bv)', 'bv')} end growth, case when why is null then u end unit from j""",
    "account_ratio": f"with o as {_ONE}, j as (select a.company_code, a.period, a.basis, {_REFUSAL} why, a.mv av, b.mv bv from o a join o b on a.company_code = b.company_code and a.period = b.period and a.basis = b.basis and a.account = '負債總額' and b.account = '資產總額') select company_code, period, basis, coalesce(why, case when bv = 0 then 'zero_denominator' end, 'OK') status, case when why is null and bv <> 0 then {_PCT('av', 'bv')} end ratio from j",
    "cross_source_check": f"with g as (select {_P}, count(*) n, count(value) v, count(distinct {_CU('unit')}) u, max(value) hi, min(value) lo, max(abs(value)) sz from fin_line_item group by {_P}) select {_P}, n, case when n < 2 then 'MISS' when v >= 2 and u <= 1 and (hi - lo) * 1000 <= sz * 5 then 'AGREE' else 'DISAGREE' end verdict, hi - lo spread from g",
    "conflict_rate": f"with g as (select {_P}, count(*) n, count(distinct value) v from fin_line_item group by {_P}) select basis, count(*) points, count_if(n > 1) several, count_if(v > 1) conflicting from g group by basis",
    "base_amounts": f"select line_id, {_CU('unit')} unit, cast(value * {_SCALE('unit')} as decimal(38, 6)) base, cast(round(cast(cast(value * 1000000 as hugeint) * {_SCALE('unit')} as double) / 1e12, 6) as decimal(38, 6)) millions from fin_line_item where {_SCALE('unit')} is not null and value is not null",
    "account_periods": "select company_code, count(distinct account) accounts, count(distinct period) periods, min(period) first_period, max(period) last_period from fin_line_item group by company_code",
    "fact_sources": "select source_kind, source_url, count(*) rows, max(loaded_at) last_loaded from fin_line_item group by all",
    "usable_facts": "select source_kind, statement, count(*) rows, count_if(value is not null and unit is not null and unit_is_uniform) usable from fin_line_item group by all",
    "fact_citations": "select line_id, company_code || ' ' || period || ' ' || account || ' [' || source_kind || ':' || source_ref || ']' citation from fin_line_item where statement = 'ratio'",
    "unit_carry": "with f as (select line_id, company_code, case when trim(unit, ' ') <> '' then unit end unit from fin_line_item where source_kind = 'extracted_text_row') select line_id, company_code, last_value(unit ignore nulls) over (partition by company_code order by line_id rows between unbounded preceding and current row) unit, unit is null inherited from f",
    "part_figures": "select p_partkey, 'p_size' account, cast(p_size as double) \"value\" from part where p_size is not null union all select p_partkey, 'p_retailprice', p_retailprice from part where p_retailprice is not null",
    "statement_cube": "select statement, basis, cast(grouping(statement, basis) as integer) level, count(*) rows, count(value) with_value from fin_line_item group by cube (statement, basis)",
    "company_industry": "with f as (select company_code, count(*) n from fin_line_item group by 1), c as (select distinct code company_code, industry_schema from company) select company_code, coalesce(n, 0) rows, industry_schema, case when n is null then 'UNUSED' when industry_schema is null then 'UNKNOWN' else 'OK' end status from f full join c using (company_code)",
}
