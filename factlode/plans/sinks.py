"""Queries over manifests, forms, reports and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factlode.functions.keys import company_code
from factlode.operators import gates, geometry as G, scoring, tables
from factlode.plans import sqltext as S
from factlode.plans.checks import _K, _kinds, _ONE, _PAY
from factlode.plans.pages import page_texts
from factlode.plans.retrieval import _TARGETS, _targets, chunks, gold
from factlode.plans.structure import SQL as _STRUCTURE, _PAGES, _printed
from factlode.runtime import load, materialise
from factlode.sources import files, manifests as M

LOCK = "0" * 64
SPEC = '{"paths": {"/a": {"get": {"summary": "資產負債表", "responses": {"200": {"schema": {"items": {"$ref": "#/definitions/A"}}}}}}, "/b": {"get": {"summary": "名單", "responses": {"200": {"schema": {"items": {"$ref": "#/definitions/B"}}}}}}, "/c": {"get": {"summary": null, "responses": {}}}}, "definitions": {"A": {"properties": {"年度": "x", "資產總額": "y"}}, "B": {"properties": {"地址": "z"}}}}'


def manifest_filings(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of filings written as YAML and read again."""
    f = load(spark, d, "filing").select("doc_id", "fiscal_year", "doc_type", "notes").distinct()
    text = materialise(M.manifest_lines(f, "doc_id", "filings\nin order"), "manifest")
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("fiscal_year", T.IntegerType()), T.StructField("doc_type", T.StringType()), T.StructField("notes", T.StringType())])
    return M.read_manifest(text, schema)


def filing_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Declared filings with what a lock holds of them; the lock lacks one year."""
    f = load(spark, d, "filing").select("doc_id", "doc_type", "fiscal_year", "pages", "source_page").distinct()
    return M.provenance(f.select("doc_id", "doc_type"), f.where("fiscal_year <> 2021"), "doc_id", ["pages", "source_page"])


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """Audited questions by type as a report."""
    r = gates.proportions(gold(spark, d), ["question_type"], "audited").select(F.col("question_type").alias("name"), "n", "k", "rate")
    return M.markdown_report(r, "synthetic questions", LOCK)


def annotation_forms(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as annotation forms and parsed again."""
    g = gold(spark, d).select("question_id", "question_set", F.array(F.concat(F.lit("ID "), "question_id"), F.concat(F.lit("Q: "), F.regexp_replace("question", r"(?U)[\s]+", " ")), F.concat(F.lit("A: "), F.coalesce("answer", F.lit(""))), F.concat(F.lit("UNIT: "), F.coalesce("unit", F.lit("")), F.lit(" "))).alias("lines"))
    n = F.xxhash64("question_id").cast("decimal(20,0)") * 10
    lines = g.select(F.col("question_set").alias("file"), "question_id", n.alias("at"), F.posexplode("lines").alias("i", "line")).select("file", (F.col("at") + F.col("i")).alias("n"), "line")
    return M.parse_forms(lines).select("file", "id", F.trim("a").alias("a"), "unit", F.col("currency").isNull().alias("no_currency"))


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of a described interface."""
    c = M.endpoint_catalogue(spark.createDataFrame([(SPEC,)], "value string"), ["資產", "損益"])
    return c.select("path", "summary", F.array_join("fields", ",").alias("fields"), "relevant")


def endpoint_years(spark: SparkSession, d: str) -> DataFrame:
    """Facts as rows of an endpoint, by year and quarter."""
    f = load(spark, d, "fin_line_item").where(F.col("period").rlike("^FY[0-9]{4}Q[1-4]$"))
    row = F.create_map(F.lit("年度"), F.substring("period", 3, 4), F.lit("季別"), F.substring("period", 8, 1), F.lit("科目"), "account")
    return M.endpoint_profile(f.select(row.alias("row")))


def label_words(spark: SparkSession, d: str) -> DataFrame:
    """Corner words of blocks by the block whose box they lie in."""
    k = _kinds(spark, d).dropDuplicates(["ord", "doc_id", "page"])
    corner = F.struct(F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), (F.col("bbox.x0") + 5).alias("x1"), (F.col("bbox.y0") + 5).alias("y1"))
    return G.words_in(k.select("doc_id", "page", F.col("ord").alias("text"), corner.alias("bbox")), k.select("ord", "doc_id", "page", "bbox"), "ord")


def row_mates(spark: SparkSession, d: str) -> DataFrame:
    """Blocks whose middles lie on one row of their page."""
    k = _kinds(spark, d).dropDuplicates(["ord", "doc_id", "page"])
    return G.same_row(k.select("ord", "doc_id", "page", "bbox"), k.select("doc_id", "page", F.col("ord").alias("text"), "bbox"), "ord", 40.0).where("ord < text")


def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Tables and the text beside them in one order."""
    k = _kinds(spark, d).dropDuplicates(["ord", "doc_id", "page"])
    return G.assemble(k.where("not is_table"), k.where("is_table"))


def load_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Cells of printed pages that become facts, and those that do not by reason."""
    p = _printed(spark, d).withColumn("text", F.when(F.col("page") % 2 == 0, F.concat(F.lit("單位：新台幣千元\n"), "text")).otherwise(F.col("text")))
    units = tables.page_units(p)
    return tables.load_rows(tables.page_rows(p), units).groupBy("reason", "statement").agg(F.count(F.lit(1)).alias("n"))


def captions_missing(spark: SparkSession, d: str) -> DataFrame:
    """Captions that are still to be made: of blocks with one, those that the questions' pages do not show."""
    c = chunks(spark, d).where(F.array_contains("kinds", "caption")).select("chunk_id", "doc_id", F.element_at("pages", 1).alias("page"))
    return c.join(_targets(spark, d).select(F.col("doc").alias("doc_id"), "page").distinct(), ["doc_id", "page"], "left_anti").select("chunk_id")


def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    """The name that each filing should have, and whether it can: keep, rename or conflict."""
    f = load(spark, d, "filing").select("doc_id", F.concat(F.lower("doc_id"), F.lit(".pdf")).alias("name"), F.format_string("公司代號：%s 民國%d年度年報", company_code(F.col("company.code")), F.col("fiscal_year") - 1911).alias("cover")).distinct()
    return files.rename_plan(f.select("doc_id", "name", *files.identify(F.upper("name"), F.col("cover"))))


def corroborated(spark: SparkSession, d: str) -> DataFrame:
    """Where recorded answers stand in the filings that their questions cite."""
    pages = page_texts(spark, d).select(F.col("doc_id").alias("doc"), "page", "text")
    return scoring.corroborate(gold(spark, d).select(F.col("question_id").alias("query"), "answer"), _targets(spark, d), pages)


QUERIES = {f.__name__: f for f in (manifest_filings, filing_provenance, report_lines, annotation_forms, endpoints, endpoint_years, label_words, row_mates, assembled_pages, load_reasons, captions_missing, rename_plan, corroborated)}

_ATOMS = "[0-9][0-9.]+|[A-Za-z]{2,}|[\\x{4e00}-\\x{9fff}]{2,}"
_LOADED = _STRUCTURE["printed_rows"]
SQL = {
    "manifest_filings": "select distinct doc_id, fiscal_year, doc_type, notes from filing",
    "filing_provenance": "select distinct doc_id, doc_type, case when fiscal_year <> 2021 then coalesce(cast(pages as varchar), '—') else '—' end pages, case when fiscal_year <> 2021 then coalesce(source_page, '—') else '—' end source_page from filing",
    "report_lines": f"with r as (select question_type name, count(*) n, count_if(audited) k from {S.GOLD} group by 1) select cast(row_number() over (order by name) + 3 as integer) place, '| ' || name || ' | ' || k || ' / ' || n || ' | ' || format('{{:,.2f}}', round(k / n, 6) * 100) || ' |' line from r union all select * from (values (0, 'synthetic questions'), (1, 'lock: {LOCK}'), (2, '| name | k / n | % |'), (3, '|-|-|-|')) t(place, line)",
    "annotation_forms": f"select question_set file, question_id id, nullif(trim(answer), '') a, nullif(trim(unit), '') unit, true no_currency from {S.GOLD}",
    "endpoints": "select * from (values ('/a', '資產負債表', '年度,資產總額', true), ('/b', '名單', '地址', false), ('/c', null, '', false)) t(path, summary, fields, relevant)",
    "endpoint_years": "select substring(period, 3, 4) \"year\", substring(period, 8, 1) \"quarter\", count(*) n, 3 \"columns\" from fin_line_item where regexp_matches(period, '^FY[0-9]{4}Q[1-4]$') group by all",
    "label_words": f"with k as {_K} select b.ord, b.doc_id, b.page, w.ord text from k w join k b on w.doc_id = b.doc_id and w.page = b.page and w.x0 >= b.x0 - 0.5 and w.x0 + 5 <= b.x1 + 0.5 and w.y0 >= b.y0 - 0.5 and w.y0 + 5 <= b.y1 + 0.5",
    "row_mates": f"with k as {_K} select a.ord, a.doc_id, a.page, b.ord text from k a join k b on a.doc_id = b.doc_id and a.page = b.page and a.ord < b.ord and abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= 40",
    "assembled_pages": f"with k as {_K}, u as (select * from k where is_table or not exists (select 1 from k r where r.is_table and r.doc_id = k.doc_id and r.page = k.page and greatest(least(r.x1, k.x1) - greatest(r.x0, k.x0), 0) * greatest(least(r.y1, k.y1) - greatest(r.y0, k.y0), 0) >= 0.5 * (k.x1 - k.x0) * (k.y1 - k.y0) and (k.x1 - k.x0) * (k.y1 - k.y0) > 0)) select doc_id, page, ord, is_table, cast(row_number() over (partition by doc_id, page order by y0, x0, is_table desc, ord, x1, y1) as integer) place from u",
    "load_reasons": f"with q as ({_LOADED}), m as (select company_code || '-' || statement doc_id, min(cast(substring(period, 3, 4) as integer)) since from fin_line_item where \"value\" is not null and abs(\"value\") < 1000000000000 and basis = 'consolidated' and company_code is not null and regexp_matches(period, '^FY[0-9]{{3}}[02468]$') group by 1), c as (select q.*, regexp_replace(label, '[(（][^()（）]*[)）]', '', 'g') account, coalesce(page >= since, false) has_unit from q left join m using (doc_id)), s as (select *, case trim(account, ' ') " + " ".join(f"when '{a}' then '{k}'" for k, xs in tables.STATEMENTS.items() for a in xs) + " end statement from c) select case when not labelled then 'unlabelled' when period is null then 'no_period' when statement is null then 'unknown_account' when not has_unit then 'no_unit' end reason, statement, count(*) n from s group by all",
    "captions_missing": f"with t as {_TARGETS}, c as (select chunk_id, doc_id, pages[1] page from (select chunk_id, any_value(doc_id) doc_id, any_value(pages) pages, any_value(kinds) kinds from chunk where chunk_id is not null group by 1) where list_contains(kinds, 'caption')) select chunk_id from c anti join t on t.doc = c.doc_id and t.page = c.page",
    "rename_plan": f"select distinct doc_id, lower(doc_id) || '.pdf' name, {S.company_code('company.code')} || '-FY' || fiscal_year || '-annual_report.pdf' target, case when count(*) over (partition by {S.company_code('company.code')}, fiscal_year) > 1 then 'conflict' else 'rename' end action from (select distinct doc_id, company, fiscal_year from filing)",
    "corroborated": f"""with t as {_TARGETS}, g as (select question_id query, answer from {S.GOLD} where answer is not null), p as (select doc_id doc, page, {_PAY(_ONE('text'))} e from {_PAGES}), d as (select distinct query, doc from t), a as (select query, {_PAY(_ONE('answer'))} a, regexp_extract_all({_PAY(_ONE('answer'))}, '{_ATOMS}') atoms from g),
j as (select query, t.query is not null own, contains(e, a) or (len(atoms) > 0 and len(list_filter(atoms, lambda x: not contains(e, x))) = 0) al, len(list_filter(atoms, lambda x: contains(e, x))) > 0 so from a join d using (query) join p using (doc) left join t using (query, doc, page)), r as (select query, count_if(al and own) here, count_if(al) pages, count_if(so) so from j group by 1)
select a.query, case when len(atoms) = 0 then 'unverifiable' when here > 0 then 'cited' when pages > 0 then 'elsewhere' when so > 0 then 'partial' else 'absent' end verdict, coalesce(pages, 0) pages from a left join r using (query)""",
}
