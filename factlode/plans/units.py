"""Queries over recorded quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlode.operators.unit_hmm import common_units, decode_units
from factlode.plans import sqltext as S
from factlode.runtime import load


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = decode_units(load(spark, d, "fin_line_item"))
    named = "value is not null and kind in ('money', 'shares') and source in ('exception', 'unit', 'note', 'label') and decoded <> 1"
    return rows.where(named).selectExpr("line_id", "decoded as scale").distinct()


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """Every figure in its common unit, or the reason why not."""
    return common_units(load(spark, d, "fin_line_item")).select("line_id", "value", "common_value", "common_unit", "reason").distinct()


def p6_likely(spark: SparkSession, d: str) -> DataFrame:
    """The scale that the model proposes for amounts and share counts without any recorded unit."""
    return common_units(load(spark, d, "fin_line_item")).where("reason = 'no_unit'").select("line_id", "likely_scale").distinct()


QUERIES = {f.__name__: f for f in (p6_found, p6_units, p6_likely)}

def _scale(u: str) -> str:
    t = f"lower({S.no_space(S.fold(u))})"
    steps = [("十億|billion|bn", 10**9), ("億", 10**8), ("百萬|million|mn", 10**6), ("萬", 10**4), ("千|仟|thousand|''000", 1000)]
    return f"case when {u} is null or {t} = '' or regexp_matches({t}, '^[(]?(%|倍)[)]?$') then null " + " ".join(f"when regexp_matches({t}, '{p}') then {v}" for p, v in steps) + " else 1 end"


_CHOSEN = f"""k as (select *, case when account like '%每股%' then 'p' when statement = 'ratio' or regexp_matches(account, '率|比率') then 'r' when account like '%股數%' then 's' else 'm' end kind from fin_line_item),
e as (select *, case when kind = 's' then coalesce(nullif(regexp_extract(unit_note, '惟股數為(.+)$', 1), ''), nullif(regexp_extract(unit_note, '除股數以(.+?)計外', 1), ''), nullif(regexp_extract(unit_note, 'except share counts in (.+)$', 1), '')) end ex,
  regexp_replace(lower(unit_note), '，?惟.*$|除(股數|每股盈餘)以.+?(計外|列示外)，?|（每股金額為.+?）|,? ?(except|other than).*$', '', 'g') note from k),
n as (select *, coalesce(nullif(regexp_extract(note, '單位[：，為]([^）]+)', 1), ''), nullif(regexp_extract(note, '以(.+?)(?:列示|表達|為單位)', 1), ''), nullif(regexp_extract(note, '\\bin (.+?)(?: unless noted otherwise|, rounded|[)]|$)', 1), '')) stated, regexp_extract({S.fold('account')}, '[(]([^()]+)[)]$', 1) label from e),
c as (select *, coalesce({_scale('ex')}, {_scale('unit')}, {_scale('stated')}, {_scale('label')}) scale, case when {_scale('ex')} is not null then ex when {_scale('unit')} is not null then unit when {_scale('stated')} is not null then stated else label end said from n)"""
_USD = f"regexp_matches(lower({S.fold('said')}), '美|u[.]?s[.]?([$]|d|dollar| )|usd')"
_TWD = f"regexp_matches(lower({S.fold('said')}), '元|nt[$]|ntd|twd|dollar|[台臺]幣')"
SQL: dict[str, str] = {
    "p6_found": f"with {_CHOSEN} select distinct line_id, cast(scale as bigint) scale from c where scale <> 1 and kind in ('s', 'm') and value is not null",
    "p6_units": f"""with {_CHOSEN}, r as (select *, case when value is null then 'no_value' when kind in ('p', 'r') then 'not_a_quantity' when scale is null then 'no_unit' end reason from c)
select distinct line_id, value, case when reason is null then cast(value * scale as decimal(38,6)) end common_value, case when reason is null then case when kind = 's' then '股' when {_USD} or (not {_TWD} and upper(currency) = 'USD') then '美元' else '元' end end common_unit, reason from r""",
}
