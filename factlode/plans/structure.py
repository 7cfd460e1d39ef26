"""Queries over the structure of pages: declared units, headings, tables, prompts, amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.functions.text import numbering_level, parse_amount, roc_period
from factlode.operators import answers as A, tables as T
from factlode.operators.scoring import figure_text
from factlode.plans import sqltext as S
from factlode.plans.pages import page_texts
from factlode.plans.retrieval import _hits, chunks, gold
from factlode.runtime import load


def section_levels(spark: SparkSession, d: str) -> DataFrame:
    """Sections of chunks with the depth that their numbering shows."""
    c = chunks(spark, d).select(F.explode("section_path").alias("section")).distinct()
    return c.select("section", numbering_level(F.col("section")).alias("level"))


def note_units(spark: SparkSession, d: str) -> DataFrame:
    """What the notes of facts declare in the registers of page text."""
    n = load(spark, d, "fin_line_item").select("unit_note").where("unit_note is not null").distinct()
    return n.select("unit_note", T.declared_unit(F.col("unit_note")).alias("u")).select("unit_note", "u.unit", "u.currency", "u.exception", "u.qualified")


def page_unit_carry(spark: SparkSession, d: str) -> DataFrame:
    return T.page_units(page_texts(spark, d))


def question_years(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("question_id", roc_period(F.col("question")).alias("period"))


def answer_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers as amounts, where they are one."""
    return gold(spark, d).select("question_id", parse_amount(F.col("answer")).alias("amount")).where("amount is not null")


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of figures that page texts hold under period headings."""
    return T.page_rows(page_texts(spark, d))


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Annual facts of each company and statement as a filing prints them: doc_id, page (the year), text."""
    f = load(spark, d, "fin_line_item").where("value is not null and abs(value) < 1000000000000 and basis = 'consolidated' and company_code is not null").where(F.col("period").rlike("^FY[0-9]{4}$"))
    year = F.substring("period", 3, 4).cast("int")
    line = F.struct("line_id", F.concat("account", F.lit(" "), figure_text(F.col("value"))).alias("line"))
    g = f.groupBy(F.concat("company_code", F.lit("-"), "statement").alias("doc_id"), year.alias("page")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("doc_id", "page", F.concat(F.format_string("民國%d年度\n", F.col("page") - 1911), F.array_join(F.transform("lines", lambda x: x.line), "\n")).alias("text"))


def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Facts read again from the pages that print them."""
    return T.page_rows(_printed(spark, d))


def resolved_cells(spark: SparkSession, d: str) -> DataFrame:
    """The figure that the rows of a filing's pages hold for the account and period of each structured source."""
    g = gold(spark, d).where("structured_source_key is not null").select(F.col("question_id").alias("key"), F.split("structured_source_key.row_key", r"\|").alias("k")).where("size(k) = 4")
    want = g.select("key", F.get("k", F.lit(0)).alias("doc_id"), F.expr("try_cast(substring(k[1], 2) as int)").alias("page"), F.get("k", F.lit(2)).alias("account"), F.get("k", F.lit(3)).alias("period"))
    return T.resolve_cells(T.table_rows(page_texts(spark, d)), want)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for every question from its five best reranked chunks; nothing is searched here."""
    h = _hits(spark, d, "rerank").where("rank <= 5").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").withColumnRenamed("doc", "doc_id")
    return A.build_prompts(gold(spark, d).select(F.col("question_id").alias("query"), "question"), h)


def page_bases(spark: SparkSession, d: str) -> DataFrame:
    return page_texts(spark, d).select("doc_id", "page", T.basis(F.col("text")).alias("basis")).groupBy("doc_id", "basis").agg(F.count(F.lit(1)).alias("pages"))


QUERIES = {f.__name__: f for f in (section_levels, note_units, page_unit_carry, question_years, answer_amounts, page_rows, printed_rows, resolved_cells, prompts, page_bases)}

_PAGES = "(select doc_id, pages[1] page, string_agg(coalesce(text, ''), chr(10) order by chunk_index, chunk_id) text from (select chunk_id, any_value(doc_id) doc_id, any_value(chunk_index) chunk_index, any_value(pages) pages, any_value(text) text from chunk where chunk_id is not null group by chunk_id) where len(pages) > 0 group by all)"
_LINE = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
def _rows_sql(pages: str) -> str:
    return f"""with l as (select doc_id, page, unnest(range(0, len(string_split_regex(nfc_normalize(text), {_LINE})))) n, unnest(string_split_regex(nfc_normalize(text), {_LINE})) line from {pages}), f as (select doc_id, page, n, regexp_replace({S.no_space('line')}, '[$＄]+', '', 'g') flat from l),
h as (select *, regexp_matches(flat, {S.q(T.PERIOD)}) and regexp_replace(regexp_replace(flat, {S.q(T.PERIOD)}, '', 'g'), {S.q(T.NOISE)}, '', 'g') = '' head from f where flat <> ''), b as (select *, head and not coalesce(lag(head) over (partition by doc_id, page order by n), false) begins from h), a as (select *, sum(cast(begins as integer)) over (partition by doc_id, page order by n) t from b),
p as (select doc_id, page, t, flatten(list(regexp_extract_all(flat, {S.q(T.PERIOD)}) order by n)) periods from a where head and t > 0 group by all), y as (select *, regexp_extract_all(flat, {S.q(T.FIGURE)}) g from a where t > 0 and not head), z as (select *, case when len(g) > 0 then string_split_regex(flat, {S.q(T.FIGURE)})[1] else flat end label from y),
o as (select *, sum(cast(regexp_matches(label, {S.q(T.NAME)}) as integer)) over (partition by doc_id, page, t order by n) k from z), r as (select doc_id, page, t, k, any_value(label order by n) filter (regexp_matches(label, {S.q(T.NAME)})) label, flatten(list(g order by n)) g from o where regexp_matches(label, {S.q(T.NAME)}) or len(g) > 0 group by all),
c as (select doc_id, page, t, len(g) m, count(*) c from r where k > 0 and len(g) > 0 group by all), u as (select doc_id, page, t, arg_min(m, (-c, m)) usual from c group by all), w as (select p.*, case when usual >= len(periods) and usual % len(periods) = 0 then usual else len(periods) end width from p left join u using (doc_id, page, t)),
x as (select r.*, w.periods, w.width, len(g) > width and len(g) % width = 0 many from r join w using (doc_id, page, t)), e as (select doc_id, page, t, k, label, periods, unnest(case when many then range(0, len(g) // width) else [0] end) part, width, g, many from x),
i as (select *, case when many then g[part * width + 1 : (part + 1) * width] else g end own, row_number() over (partition by doc_id, page, t order by k, part) - 1 nr, dense_rank() over (partition by doc_id, page order by t) - 1 nt from e), q as (select *, unnest(range(0, len(own))) col, unnest(own) figure from i)
select doc_id, page, cast(nt as integer) "table", cast(nr as integer) "row", case when k > 0 and part = 0 then label else '' end label, k > 0 and part = 0 labelled, cast(col as integer) "column", periods[col + 1] period, figure from q"""


_T = f"trim({S.fold('section')}, ' ')"
_D = S.q(T.DECLARES)
_M = lambda p: f"regexp_matches({_T}, '{p}')"
_CJ = "一二三四五六七八九十"
_NUM = f"trim({S.fold('answer')}, ' ')"
_IN = f"regexp_extract({_NUM}, '^\\(\\s*(.+?)\\s*\\)$', 1)"
_DIG = f"regexp_replace(case when {_IN} <> '' then {_IN} else {_NUM} end, '[^0-9.\\-+eE]', '', 'g')"
SQL = {
    "section_levels": f"""select distinct section, cast(case when {_M(f'^第[{_CJ}百]+[章編部]')} then 1 when {_M('^[壹貳參肆伍陸柒捌玖拾]+[、.]')} then 1 when {_M(f'^第[{_CJ}百]+節')} then 2 when {_M(f'^[{_CJ}]+[、.]')} then 2 when {_M(f'^[(][{_CJ}]+[)]')} then 3
when {_M('^[0-9]+([.][0-9]+){1,5}([^0-9]|$)')} then least(6, len(string_split(regexp_extract({_T}, '^([0-9]+(?:[.][0-9]+)+)', 1), '.')) + 3) when {_M('^[0-9]{1,2}[、.]([^0-9]|$)')} then 4 when {_M('^[(][0-9]{1,2}[)]')} then 5 end as integer) "level" from (select unnest(section_path) section from {S.CHUNKS})""",
    "page_unit_carry": f"""with n as (select doc_id, page, text, regexp_extract(text, {_D}, 0) w, regexp_extract(text, {_D}, 2) u from {_PAGES}), t as (select *, substring(text, position(w in text) + length(w), 60) tail from n),
d as (select doc_id, page, case when u <> '' then {{'unit': {S.canonical_unit('u')}, 'exception': case when regexp_extract(tail, {S.q(T.EXCEPTS)}, 2) <> '' then regexp_extract(tail, {S.q(T.EXCEPTS)}, 1) || '為' || {S.canonical_unit(f"regexp_extract(tail, {S.q(T.EXCEPTS)}, 2)")} end, 'on': page}} end s from t),
h as (select doc_id, page, last_value(s ignore nulls) over (partition by doc_id order by page rows between unbounded preceding and current row) h from d) select doc_id, page, h.unit unit, case when h."on" = page then h.exception end "exception", h."on" declared_on, case when h."on" <> page then '承第' || h."on" || '頁之單位' end note from h""",
    "page_rows": _rows_sql(_PAGES),
    "printed_rows": _rows_sql(f"""(select company_code || '-' || statement doc_id, cast(substring(period, 3, 4) as integer) page, '民國' || (cast(substring(period, 3, 4) as integer) - 1911) || '年度' || chr(10) || string_agg(account || ' ' || case when "value" % 1 <> 0 then format('{{:,.2f}}', cast(round_even("value", 2) as double)) else format('{{:,.0f}}', cast("value" as double)) end, chr(10) order by line_id) text
from fin_line_item where "value" is not null and abs("value") < 1000000000000 and basis = 'consolidated' and company_code is not null and regexp_matches(period, '^FY[0-9]{{4}}$') group by company_code, statement, period)"""),
    "prompts": f"""with r as (select question_id query, chunk_id, min(rank) rank, any_value(doc_id) doc_id, any_value(pages) pages from hit where retriever = 'rerank' group by all having min(rank) <= 5), c as (select r.*, coalesce(c.text, '') text, row_number() over (partition by query order by rank) k from r join {S.CHUNKS} c using (chunk_id)),
p as (select query, string_agg('[' || k || '] ' || doc_id || ' p' || array_to_string(pages, ',') || chr(10) || text, chr(10) || chr(10) order by rank) passages from c group by query)
select g.question_id query, coalesce(passages, '') || chr(10) || chr(10) || '問題：' || question || chr(10) || '請依下列格式回答：' || chr(10) || '答案：' || chr(10) || '單位：' || chr(10) || '期間：' || chr(10) || '依據：' prompt from {S.GOLD} g left join p on p.query = g.question_id""",
    "note_units": f"""with n as (select distinct unit_note, regexp_extract(unit_note, {_D}, 0) w, regexp_extract(unit_note, {_D}, 1) c, regexp_extract(unit_note, {_D}, 2) u from fin_line_item where unit_note is not null), p as (select *, position(w in unit_note) a from n), t as (select *, substring(unit_note, a + length(w), 60) tail from p)
select unit_note, case when u <> '' then {S.canonical_unit('u')} end unit, case when u <> '' and c <> '' then c end currency, case when u <> '' and regexp_extract(tail, {S.q(T.EXCEPTS)}, 2) <> '' then regexp_extract(tail, {S.q(T.EXCEPTS)}, 1) || '為' || {S.canonical_unit(f"regexp_extract(tail, {S.q(T.EXCEPTS)}, 2)")} end "exception", u <> '' and regexp_matches(substring(unit_note, greatest(a - 40, 1), least(a - 1, 40) + length(w)), '{T.QUALIFIES}') qualified from t""",
    "question_years": f"select question_id, case when regexp_extract(question, '(?i)FY([0-9]{{4}})', 1) <> '' then 'FY' || regexp_extract(question, '(?i)FY([0-9]{{4}})', 1) when regexp_extract(' ' || question, '[^0-9]([0-9]{{4}})\\s*年', 1) <> '' then 'FY' || regexp_extract(' ' || question, '[^0-9]([0-9]{{4}})\\s*年', 1) when regexp_extract(' ' || question, '[^0-9]([0-9]{{2,3}})\\s*年', 1) <> '' then 'FY' || (cast(regexp_extract(' ' || question, '[^0-9]([0-9]{{2,3}})\\s*年', 1) as integer) + 1911) end period from {S.GOLD}",
    "answer_amounts": f"with a as (select question_id, case when lower({_NUM}) in ('', '-', '–', '—', 'n/a', 'na', 'nil', '不適用', '無') or {_DIG} in ('', '-', '+', '.', '-.', '+.') then null else try_cast({_DIG} as decimal(38, 6)) end v, {_IN} <> '' neg from {S.GOLD}) select question_id, case when neg then -v else v end amount from a where v is not null",
    "page_bases": f"with p as (select doc_id, case when regexp_extract(text, '(個體財務報[告表]|母公司個體)|(合併財務報[告表])', 0) like '%個體%' then 'parent_only' else 'consolidated' end basis from {_PAGES}) select doc_id, basis, count(*) pages from p group by all",
}
