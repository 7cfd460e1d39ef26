"""Queries over places and files: boxes on pages, offsets, capabilities, identities, addresses, stored forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factlode.functions import fields as R
from factlode.functions.keys import company_code
from factlode.functions.text import REFUSALS
from factlode.operators import answering, capability as K, geometry as G, lexical, pages as P, scoring
from factlode.operators.questions import ROUTE_OF
from factlode.plans import sqltext as S
from factlode.plans.answering import SQL as _ANSWERING
from factlode.plans.pages import page_texts
from factlode.plans.retrieval import SQL as _RETRIEVAL, chunks, gold
from factlode.plans.structure import _PAGES
from factlode.runtime import load, scratch
from factlode.sources import files, jsonl, stores

HOSTS = ["data.example"]


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of chunks: chunk_id, doc_id, page, bbox."""
    b = chunks(spark, d).select("chunk_id", "doc_id", F.explode("bboxes").alias("b")).where("size(b.bbox) = 4")
    box = F.struct(*[F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return b.select("chunk_id", "doc_id", F.col("b.page").alias("page"), box.alias("bbox"))


def page_extents(spark: SparkSession, d: str) -> DataFrame:
    """The box around all chunks of each page."""
    return G.page_union(_boxes(spark, d), ["doc_id", "page"]).select("doc_id", "page", *[F.col(f"bbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose boxes lie in each other by half or more."""
    return G.overlapping(_boxes(spark, d), "chunk_id")


def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    """The order in which the chunks of a page are read."""
    return G.reading_order(_boxes(spark, d), ties=("bbox.y0", "chunk_id", "bbox.x1", "bbox.y1")).select("doc_id", "page", "chunk_id", "reading_order")


def page_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where each page lies in the text of its filing."""
    return P.page_offsets(page_texts(spark, d))


def year_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of chunks that follow a year closely."""
    c = chunks(spark, d).select("chunk_id", F.posexplode(R.year_values(F.col("text"))).alias("place", "x"))
    return c.select("chunk_id", "place", F.col("x.year").alias("year"), F.col("x.value").alias("figure"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """What is measured of each filing: verdict by length, legible pages, tables, tables with a unit, captions."""
    c = chunks(spark, d)
    table = F.array_contains("kinds", "table")
    per = c.groupBy("doc_id").agg(F.count_if(table).alias("tables"), F.count_if(table & F.contains("text", F.lit("元"))).alias("tables_with_unit"), F.count_if(F.array_contains("kinds", "caption")).alias("labelled_charts"))
    legible = P.defect_verdicts(load(spark, d, "page_defect").distinct()).where("not garbled and characters > 0").groupBy("doc_id").agg(F.count_distinct("page").alias("legible_pages"))
    f = load(spark, d, "filing").select("doc_id", F.when(F.col("pages") < P.MIN_PAGES, "too_short").otherwise("usable").alias("verdict")).distinct()
    return f.join(per, "doc_id", "left").join(legible, "doc_id", "left").na.fill(0)


def filing_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """The types of questions that each filing can serve."""
    return K.capability(_counts(spark, d)).withColumn("sources", F.array_join("sources", ","))


def type_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many filings can serve each type of question."""
    return K.coverage(K.capability(_counts(spark, d)))


def file_identities(spark: SparkSession, d: str) -> DataFrame:
    """Filings identified by a file name and a cover made from the manifest."""
    f = load(spark, d, "filing").select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("name"), F.format_string("%s 股票代號：%s 民國%d年度財務報告", "company.name", "company.code", F.col("fiscal_year") - 1911).alias("cover")).distinct()
    return f.select("doc_id", *files.identify(F.col("name"), F.col("cover")))


def address_problems(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of facts that may not be fetched, by reason."""
    u = load(spark, d, "fin_line_item").where("source_url is not null")
    return u.groupBy(files.url_problem(F.col("source_url"), HOSTS).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def text_digests(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of every chunk's text, and the first chunk of each digest."""
    c = chunks(spark, d).where("text is not null").select(F.sha2("text", 256).alias("sha256"), "chunk_id")
    return c.groupBy("sha256").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first"))


def jsonl_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as lines of JSON and read again under a strict schema."""
    path = f"{scratch(spark)}/jsonl-{uuid.uuid4().hex}"
    jsonl.write_jsonl(gold(spark, d).select("question_id", "question", "answer", "answerable", "page_numbers"), path)
    schema = T.StructType([T.StructField("question_id", T.StringType(), False), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("answerable", T.BooleanType()), T.StructField("page_numbers", T.ArrayType(T.IntegerType()))])
    return jsonl.read_jsonl(spark, path, schema)[0]


def stored_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term statistics of an index that was stored and opened again without problems."""
    path = f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    stores.save_index(load(spark, d, "chunk"), "chunk_id", "text", path)
    post, problems = stores.load_index(spark, path)
    if not problems.isEmpty():
        raise ValueError("the stored index differs from its manifest")
    return lexical.term_stats(post)


def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that can't be searched, by reason (those not of unit length are scaled before a search)."""
    return stores.vector_problems(load(spark, d, "embeddings"), "vec_id", "embedding", 64).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Texts that an index takes: chunks of text, and captions by themselves under ids of their own."""
    c = chunks(spark, d).where("text is not null")
    caption = F.array_contains("kinds", "caption")
    rows = c.select("chunk_id", "doc_id", "text").unionByName(c.where(caption).select(F.concat("chunk_id", F.lit(":caption")).alias("chunk_id"), "doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("characters"))


def answer_text_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each recorded answer scored as text against its first variant (where there is none, against itself)."""
    g = gold(spark, d).where("answer is not null").select("question_id", "answer", F.array().cast("array<string>").alias("acceptable_variants"), "unit", "period", "tolerance", "answerable", F.coalesce(F.get("acceptable_variants", F.lit(0)), F.col("answer")).alias("predicted"), F.lit("千元").alias("predicted_unit"), F.col("period").alias("predicted_period"))
    s = scoring.score_answers(g)
    return s.select("question_id", "exact", "f1", "unit_ok", "period_ok", "refused", "should_refuse")


def protocol_scores(spark: SparkSession, d: str) -> DataFrame:
    """How many recorded answers hold to the letter of the protocol, their first variant standing for what was said."""
    from factlode.plans.evaluation import answer_scores

    return answer_scores(spark, d).select(scoring.protocol_correct().alias("right"), "correct").groupBy("right", "correct").agg(F.count(F.lit(1)).alias("n"))


def rung_list(spark: SparkSession, d: str) -> DataFrame:
    """The rungs of the ladder as a table."""
    return spark.createDataFrame(answering.LADDER, "factor string, parser string, mode string, numeric boolean, chart boolean, committed boolean")


def ordered_records(spark: SparkSession, d: str) -> DataFrame:
    """Filings as JSON with their keys in order."""
    f = load(spark, d, "filing").distinct()
    return f.select("doc_id", R.stable_json(F.create_map(F.lit("year"), F.col("fiscal_year").cast("string"), F.lit("code"), company_code(F.col("company.code")), F.lit("type"), F.col("doc_type"))).alias("json"))


def plain_paths(spark: SparkSession, d: str) -> DataFrame:
    """References of facts that may serve as relative paths."""
    return load(spark, d, "fin_line_item").groupBy(R.plain_path(F.col("source_ref")).alias("ref_ok"), R.plain_path(F.col("source_url")).alias("url_ok")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (page_extents, box_overlaps, chunk_order, page_starts, year_figures, filing_capabilities, type_coverage, file_identities, address_problems, text_digests, jsonl_questions, stored_terms, vector_checks, index_rows, answer_text_scores, protocol_scores, rung_list, ordered_records, plain_paths)}

_C = "(select chunk_id, any_value(doc_id) doc_id, any_value(bboxes) bboxes, any_value(kinds) kinds, any_value(text) text from chunk where chunk_id is not null group by chunk_id)"
_BOX = f"(select chunk_id, doc_id, b.page page, b.bbox[1] x0, b.bbox[2] y0, b.bbox[3] x1, b.bbox[4] y1 from (select chunk_id, doc_id, unnest(bboxes) b from {_C}) where len(b.bbox) = 4)"
_COUNTS = f"""(with v as (select distinct * from page_defect), l as (select doc_id, count(distinct page) legible_pages from v where characters > 0 and not (characters >= {P.MIN_CHARACTERS} and (off_script + controls + private_use + other) / characters > {P.GARBLED}) group by 1),
c as (select doc_id, count_if(list_contains(kinds, 'table')) tables, count_if(list_contains(kinds, 'table') and contains(text, '元')) tables_with_unit, count_if(list_contains(kinds, 'caption')) labelled_charts from {_C} group by 1), f as (select distinct doc_id, case when pages < {P.MIN_PAGES} then 'too_short' else 'usable' end verdict from filing)
select doc_id, verdict, coalesce(tables, 0) tables, coalesce(tables_with_unit, 0) tables_with_unit, coalesce(labelled_charts, 0) labelled_charts, coalesce(legible_pages, 0) legible_pages from f left join c using (doc_id) left join l using (doc_id))"""
_SRC = f"case when verdict = 'too_short' then [] else list_filter([case when labelled_charts >= {K.CHARTS} then 'chart_value_trend' end, case when legible_pages >= {K.PAGES} and tables >= {K.TABLES} then 'cross_document' end, case when legible_pages >= {K.PAGES} then 'cross_page' end, case when tables >= {K.TABLES} and tables_with_unit >= {K.WITH_UNIT} then 'cross_period_comparison' end, case when legible_pages >= {K.PAGES} then 'narrative_fact' end, case when tables >= {K.TABLES} and tables_with_unit >= {K.WITH_UNIT} then 'numeric_calculation' end, case when tables >= {K.TABLES} then 'table_cell' end], lambda x: x is not null) end"
_YV = "([0-9]{2,4})年[^0-9]{0,24}?(-?[0-9][0-9,]*(?:[.][0-9]+)?)"
_REPUBLIC = r"([^0-9])(?:民國)?([0-9]{2,3})\s*年"
_ERA = lambda c: f"substring(array_to_string(list_transform(string_split_regex(' ' || {c}, '{_REPUBLIC}'), lambda x, i: x || coalesce(regexp_extract_all(' ' || {c}, '{_REPUBLIC}', 1)[i] || (cast(regexp_extract_all(' ' || {c}, '{_REPUBLIC}', 2)[i] as integer) + 1911) || '年', '')), ''), 2)"
_FORM = lambda c: f"replace(lower({S.no_space(f"replace(regexp_replace({S.fold(_ERA(c))}, '新台幣|新臺幣|NT\\$|NTD|TWD|\\$', 'TWD', 'g'), ',', '')")}), 'ß', 'ss')"
_COMMON = "list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda y: y = g)), len(list_filter(z, lambda y: y = g)))))"
_FIGURES = lambda c: f"regexp_replace(regexp_replace(regexp_replace({S.no_space(f"replace({S.fold(c)}, ',', '')")}, '[(]([0-9][0-9.]*)[)]', '-\\1', 'g'), case when trim(unit) <> '' then '([0-9])' || regexp_escape(trim({S.fold('unit')})) else '([0-9])$^' end, '\\1 ', 'g'), '-?[0-9]+(?:[.][0-9]+)?年', ' ', 'g')"
_NUMBERS = lambda c: f"list_transform(range(1, len(regexp_extract_all({_FIGURES(c)}, '(-?[0-9]+(?:[.][0-9]+)?)([億萬千])?', 1)) + 1), lambda i: cast(regexp_extract_all({_FIGURES(c)}, '(-?[0-9]+(?:[.][0-9]+)?)([億萬千])?', 1)[i] as double) * case regexp_extract_all({_FIGURES(c)}, '(-?[0-9]+(?:[.][0-9]+)?)([億萬千])?', 2)[i] when '億' then 1e8 when '萬' then 1e4 when '千' then 1e3 else 1 end)"


def scores_sql(rows: str) -> str:
    """Scores of rows (question_id, answer, acceptable_variants, unit, period, tolerance, answerable, predicted, predicted_unit, predicted_period)."""
    return f"""(with s0 as (select *, {_FORM("coalesce(predicted, '')")} p, {_FORM('answer')} w, {_NUMBERS("coalesce(predicted, '')")} got, {_NUMBERS('answer')} wanted from {rows}), s1 as (select *, {S.bigrams('p')} x, {S.bigrams('w')} z from s0),
s2 as (select question_id, answerable, coalesce(p = w, false) or list_contains(list_transform(coalesce(acceptable_variants, []), lambda v: lower({S.no_space("replace(v, ',', '')")})), p) "exact", case when w is not null then round(case when len(x) + len(z) > 0 then 2.0 * coalesce({_COMMON}, 0) / (len(x) + len(z)) else 1.0 end, 6) end f1,
case when answer is null or len(wanted) = 0 then null when len(got) <> len(wanted) then false else len(list_filter(range(1, len(wanted) + 1), lambda i: not case when tolerance.type = 'absolute' then abs(got[i] - wanted[i]) <= coalesce(tolerance.value, 0) when tolerance.type = 'relative' and wanted[i] <> 0 then abs(got[i] - wanted[i]) <= coalesce(tolerance.value, 0) * abs(wanted[i]) else got[i] = wanted[i] end)) = 0 end "numeric",
case when unit is not null then coalesce({S.canonical_unit('predicted_unit')} = {S.canonical_unit('unit')}, false) end unit_ok, coalesce({_FORM('predicted_period')} = {_FORM('period')}, false) period_ok, {" or ".join(f"contains(p, '{r}')" for r in REFUSALS)} refused from s1)
select question_id, "exact", f1, "numeric", unit_ok, period_ok, refused, not answerable should_refuse, case when not answerable then refused else not refused and (coalesce("numeric", false) or "exact") and coalesce(unit_ok, true) and period_ok end correct from s2)"""


_ANSWERED = "(select question_id, answer, acceptable_variants, unit, period, tolerance, answerable, coalesce(acceptable_variants[1], answer, '文件中沒有') predicted, unit predicted_unit, period predicted_period from (select question_id, any_value(answer) answer, any_value(acceptable_variants) acceptable_variants, any_value(unit) unit, any_value(period) period, any_value(tolerance) tolerance, any_value(answerable) answerable from gold where question_id is not null group by 1))"
_PLAIN = lambda c: f"coalesce({c} <> '' and not regexp_matches({c}, '^/|^[A-Za-z]:|\\\\|(^|/)[.]{{1,2}}(/|$)|//|/$'), false)"
SQL = {
    "page_extents": f"select doc_id, page, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from {_BOX} group by all",
    "box_overlaps": f"""with b as {_BOX}, j as (select a.doc_id, a.page, a.chunk_id chunk_id_1, c.chunk_id chunk_id_2, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0.0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0.0) i, greatest(a.x1 - a.x0, 0.0) * greatest(a.y1 - a.y0, 0.0) p, greatest(c.x1 - c.x0, 0.0) * greatest(c.y1 - c.y0, 0.0) q from b a join b c on a.doc_id = c.doc_id and a.page = c.page and a.chunk_id < c.chunk_id)
select doc_id, page, chunk_id_1, chunk_id_2, round(i / least(p, q), 6) overlap, round(i / (p + q - i), 6) iou from j where least(p, q) > 0 and i / least(p, q) >= {G.SHARE}""",
    "chunk_order": f"select doc_id, page, chunk_id, cast(row_number() over (partition by doc_id, page order by round_even(y0 / 3.0, 0), x0, y0, chunk_id, x1, y1) - 1 as integer) reading_order from {_BOX}",
    "page_starts": f"with p as (select doc_id, page, length(text) n from {_PAGES} where length(text) > 0), s as (select *, coalesce(sum(n + 1) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) a from p) select doc_id, page, cast(a as bigint) \"start\", cast(a + n as bigint) \"end\" from s",
    "year_figures": f"with c as (select chunk_id, regexp_extract_all(text, '{_YV}', 1) y, regexp_extract_all(text, '{_YV}', 2) v from {_C}), e as (select chunk_id, unnest(range(0, len(y))) place, unnest(y) \"year\", unnest(v) figure from c) select chunk_id, cast(place as integer) place, \"year\", figure from e",
    "filing_capabilities": f"select doc_id, verdict, tables, tables_with_unit, labelled_charts, legible_pages, array_to_string({_SRC}, ',') sources from {_COUNTS}",
    "type_coverage": f"with s as (select doc_id, unnest({_SRC}) question_type from {_COUNTS}) select question_type, count(distinct doc_id) documents, min(doc_id) \"first\", max(doc_id) \"last\" from s group by 1",
    "file_identities": "select distinct doc_id, company.code code, fiscal_year, 'financial_report' doc_type, case when company.code <> substring(doc_id, 1, 4) or cast(substring(doc_id, 8, 4) as integer) <> fiscal_year then 'CONFLICT' else 'OK' end status from filing",
    "address_problems": "select case when not regexp_matches(lower(source_url), '^https:') then 'scheme' when regexp_extract(lower(source_url), '^https://([^/?#]*)', 1) <> 'data.example' then 'host' end problem, count(*) n from fin_line_item where source_url is not null group by 1",
    "text_digests": f"select sha256(text) sha256, count(*) chunks, min(chunk_id) \"first\" from {_C} where text is not null group by 1",
    "jsonl_questions": "select question_id, any_value(question) question, any_value(answer) answer, any_value(answerable) answerable, any_value(page_numbers) page_numbers from gold where question_id is not null group by question_id",
    "answer_text_scores": f"""with g as (select question_id, {_FORM('coalesce(acceptable_variants[1], answer)')} p, {_FORM('answer')} w, unit, period, answerable from (select question_id, any_value(answer) answer, any_value(acceptable_variants) acceptable_variants, any_value(unit) unit, any_value(period) period, any_value(answerable) answerable from gold where question_id is not null group by 1) where answer is not null), f as (select *, {S.bigrams('p')} x, {S.bigrams('w')} z from g)
select question_id, p = w "exact", round(case when len(x) + len(z) > 0 then 2.0 * coalesce({_COMMON}, 0) / (len(x) + len(z)) else 1.0 end, 6) f1, case when unit is not null then coalesce({S.canonical_unit('unit')} = '千元', false) end unit_ok, period is not null period_ok, {" or ".join(f"contains(p, '{r}')" for r in REFUSALS)} refused, not answerable should_refuse from f""",
    "index_rows": f"with c as (select * from {_C} where text is not null), r as (select doc_id, text from c union all select doc_id, text from c where list_contains(kinds, 'caption')) select doc_id, count(*) \"rows\", cast(sum(length(text)) as bigint) characters from r group by 1",
    "stored_terms": _RETRIEVAL["term_stats"],
    "vector_checks": "with e as (select list_transform(embedding, lambda x: cast(x as double)) v, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) n from embeddings), w as (select case when v is null then 'null' when len(v) <> 64 then 'dimension' when n is null or isnan(n) or isinf(n) then 'not_finite' when n = 0 then 'zero' when abs(n - 1) > 0.001 then 'not_unit' end problem from e) select problem, count(*) n from w where problem is not null group by 1",
    "answer_scores": f"select * from {scores_sql(_ANSWERED)}",
    "protocol_scores": f'with s as {scores_sql(_ANSWERED)} select case when should_refuse then refused when refused then false else coalesce("numeric", "exact" or coalesce(f1 >= 0.8, false)) end "right", correct, count(*) n from s group by all',
    "ladder_summary": f"""with l as ({_ANSWERING['ladder']}), g as (select question_id, any_value(question_type) category, any_value(answer) answer, any_value(acceptable_variants) acceptable_variants, any_value(unit) unit, any_value(period) period, any_value(tolerance) tolerance, any_value(answerable) answerable from gold where question_id is not null group by 1),
r as (select l.factor || '|' || l.question_id question_id, answer, acceptable_variants, unit, period, tolerance, answerable, said predicted, said_unit predicted_unit, said_period predicted_period from l join g using (question_id)), c as (select question_id, correct from {scores_sql('r')}),
e as (select l.*, g.category, g.answerable, c.correct, case g.category {' '.join(f"when '{a}' then '{b}'" for a, b in ROUTE_OF.items())} end gold_route from l join g using (question_id) join c on c.question_id = l.factor || '|' || l.question_id),
m as (select factor, unnest([{{'m': 'accuracy', 's': true, 'h': correct}}, {{'m': 'citation', 's': cited_ok is not null, 'h': cited_ok}}, {{'m': 'numeric_route', 's': category in ('numeric_calculation', 'cross_period_comparison') and answerable and handled_route = 'numeric', 'h': correct}}, {{'m': 'route', 's': true, 'h': route = gold_route}}, {{'m': 'over_answer', 's': category = 'unanswerable', 'h': not refused}}, {{'m': 'refusal_precision', 's': refused, 'h': not answerable}}]) x from e),
n as (select factor, x.m measure, count_if(x.s) n, count_if(x.s and x.h) k from m group by all) select factor, measure, n, k, case when n > 0 then round(k / n, 6) end rate from n""",
    "rung_list": "select * from (values " + ", ".join(f"('{f}', '{p}', '{m}', {n}, {c}, {t})" for f, p, m, n, c, t in answering.LADDER) + ') l(factor, parser, mode, "numeric", chart, committed)',
    "ordered_records": f"select distinct doc_id, '{{\"code\":\"' || {S.company_code('company.code')} || '\",\"type\":\"' || doc_type || '\",\"year\":\"' || fiscal_year || '\"}}' json from filing",
    "plain_paths": f"select {_PLAIN('source_ref')} ref_ok, {_PLAIN('source_url')} url_ok, count(*) n from fin_line_item group by all",
}
