"""Queries over layouts, locks, gates and evidence: what the operators of those names say of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.functions.keys import filing_id
from factlode.operators import answers, audit, gates, geometry as G, layout, tables as T, validate as V
from factlode.operators.scoring import figure_text, supports
from factlode.plans import sqltext as S
from factlode.plans.places import _BOX, _C
from factlode.plans.retrieval import _HITS, _TARGETS, _hits, _targets, chunks, gold
from factlode.runtime import load
from factlode.sources import openapi

HEIGHT, AREA = 842.0, 595.0 * 842.0
MEASURES = {"data_reproducible": 1.0, "results_reproducible": 1.0, "pooled_gain": 16.0, "single_gain": 11.0, "regression": 2.0, "citation": 0.95, "numeric_route": 0.92, "route": 0.9, "over_answer": 0.1, "refusal_precision": 0.85, "probe_refusals": 5.0, "retrieval_p95": 0.2, "generation_p95": 80.0, "memory_gb": 12.0}


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of chunks with what the chunk holds: ord (the chunk), doc_id, page, bbox, index, is_table, is_caption, text."""
    c = chunks(spark, d).select(F.col("chunk_id").alias("ord"), "doc_id", F.col("chunk_index").alias("index"), F.coalesce(F.array_contains("kinds", "table"), F.lit(False)).alias("is_table"), F.coalesce(F.array_contains("kinds", "caption"), F.lit(False)).alias("is_caption"), "text", F.explode("bboxes").alias("b"))
    box = F.struct(*[F.get("b.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return c.where("size(b.bbox) = 4").select("ord", "doc_id", F.col("b.page").alias("page"), box.alias("bbox"), "index", "is_table", "is_caption", "text")


def free_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of text of which no table of their page covers half."""
    k = _kinds(spark, d)
    return G.uncovered(k.where("not is_table"), k.where("is_table").select("doc_id", "page", "bbox")).select("ord", "doc_id", "page").distinct()


def captions_near(spark: SparkSession, d: str) -> DataFrame:
    """The caption nearest to each block that is none."""
    k = _kinds(spark, d).dropDuplicates(["ord", "doc_id", "page"])
    found = G.nearest_caption(k.where("not is_caption").select("doc_id", "page", "ord", "bbox"), k.where("is_caption").select("doc_id", "page", "ord", "bbox", F.col("ord").alias("text")))
    return found.select("doc_id", "page", "ord", "caption").where("caption is not null")


def table_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Tables that begin near the top of a page while one as wide ends near the foot of the page before."""
    k = _kinds(spark, d).where("is_table").dropDuplicates(["ord", "doc_id", "page"])
    t = k.select("doc_id", "page", "ord", (F.col("index") % 2).alias("n_cols"), (F.col("bbox.y0") / HEIGHT).alias("y0"), (F.col("bbox.y1") / HEIGHT).alias("y1"))
    return G.continuations(t).select("doc_id", "page", "ord", "continues_from_page")


def chart_figures(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that may be charts: of a fit shape, under no table, with three labels; every block stands for three at its own corner."""
    k = _kinds(spark, d).dropDuplicates(["ord", "doc_id", "page"])
    figures = k.where("not is_table").select("doc_id", "page", "ord", "bbox", F.lit(AREA).alias("page_area"))
    at = lambda i: F.struct((F.col("bbox.x0") + i).alias("x0"), F.col("bbox.y0").alias("y0"), (F.col("bbox.x0") + i + 1).alias("x1"), (F.col("bbox.y0") + 1).alias("y1"))
    words = k.select("doc_id", "page", F.explode(F.array(*[F.struct(at(i).alias("bbox"), F.lit(t).alias("text")) for i, t in enumerate(("1,234", "(5.6)", "7%", "年"))])).alias("w")).select("doc_id", "page", "w.text", "w.bbox")
    return G.chart_candidates(figures, k.where("is_table").select("doc_id", "page", "bbox"), words).select("doc_id", "page", "ord", "numeric_labels")


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Consolidated facts of a company and period as rows of two cells."""
    f = load(spark, d, "fin_line_item").where("basis = 'consolidated' and company_code is not null and (value is null or abs(value) < 1000000000000)")
    cells = F.struct("line_id", F.array("account", F.coalesce(figure_text(F.col("value")), F.lit(" "))).alias("cells"))
    return f.groupBy("company_code", "period").agg(F.transform(F.array_sort(F.collect_list(cells)), lambda x: x.cells).alias("rows"))


def shaped_tables(spark: SparkSession, d: str) -> DataFrame:
    """Whether facts printed side by side make a table, and its measures."""
    return _sheets(spark, d).select("company_code", "period", *T.table_shape(F.col("rows")))


def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same as lines of cells under a header."""
    return _sheets(spark, d).select("company_code", "period", T.table_text(F.col("rows"), F.lit("單位：千元")).alias("text"))


def openapi_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as an open-data interface gives them, one wide row per company and period, and back."""
    f = load(spark, d, "fin_line_item").where("basis = 'consolidated' and company_code is not null").where(F.col("period").rlike("^FY[0-9]{4}(Q[1-4])?$")).groupBy("company_code", "period", "account").agg(F.max("value").alias("value"))
    name = F.when(F.col("account").startswith("營業"), F.concat("account", F.lit("（百萬元）"))).otherwise(F.concat("account", F.lit(" ")))
    entry = F.struct(name.alias("k"), F.coalesce(F.col("value").cast("string"), F.lit("-")).alias("v"))
    rows = f.groupBy("company_code", "period").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    head = F.create_map(F.lit("年度"), (F.substring("period", 3, 4).cast("int") - 1911).cast("string"), F.lit("公司代號"), F.col("company_code"))
    quarter = F.when(F.length("period") > 6, F.create_map(F.lit("季別"), F.substring("period", 8, 1))).otherwise(F.create_map(F.lit("公司名稱"), F.lit("")))
    got = openapi.unpivot_rows(rows.select(F.map_concat(head, quarter, "m").alias("row")), "千元")
    return got.select("company_code", "period", F.trim("account").alias("account"), "unit", "value")


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits by the order of a new score, ties in the order they came in."""
    h = _hits(spark, d, "lexical").dropDuplicates(["query", "rank"])
    return answers.rerank(h.select("query", "chunk_id", "rank"), F.length("chunk_id") % 3).select("query", "chunk_id", "before", "rank")


def lock_changes(spark: SparkSession, d: str) -> DataFrame:
    """A lock of the manifest against a later state of it: one year was added, one kind left out, annual reports have a page more."""
    f = load(spark, d, "filing").select("doc_id", "doc_type", "fiscal_year", "pages").distinct()
    sign = V.row_digest(F.col("doc_id"), F.col("doc_type"), F.col("pages")).alias("sha256")
    later = f.where("doc_type <> 'xbrl'").withColumn("pages", F.when(F.col("doc_type") == "annual_report", F.col("pages") + 1).otherwise(F.col("pages")))
    return V.digest_changes(f.where("fiscal_year <> 2020").select("doc_id", sign), later.select("doc_id", sign), "doc_id")


def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The gates over one set of measures: all pass but the soft one."""
    return gates.decide(spark.createDataFrame(list(MEASURES.items()), "metric string, value double"))


def claimed_rates(spark: SparkSession, d: str) -> DataFrame:
    """A summary with one rate changed, one left out and one made up, against its recomputation."""
    now = gates.proportions(gold(spark, d), ["question_type"], "audited").select("question_type", "n", "k", "rate")
    claimed = now.where("question_type <> 'cross_page'").withColumn("k", F.when(F.col("question_type") == "table_cell", F.col("k") + 1).otherwise(F.col("k")))
    made_up = spark.createDataFrame([("ghost", 1, 1, 1.0)], "question_type string, n long, k long, rate double")
    return gates.verify(claimed.unionByName(made_up), now, ["question_type"]).select("question_type", "kind")


def graded_citations(spark: SparkSession, d: str) -> DataFrame:
    """The three best reranked passages of each question as its citations, held against its evidence."""
    g = gold(spark, d)
    h = _hits(spark, d, "rerank").where("rank <= 3").join(g.select(F.col("question_id").alias("query"), "answerable"), "query")
    none = F.lit(None).cast("string")
    cites = h.select("query", F.col("doc").alias("doc_id"), F.element_at("pages", 1).alias("page"), none.alias("row"), none.alias("column"), (~F.col("answerable")).alias("refused"))
    e = g.select(F.col("question_id").alias("query"), F.explode("required_evidence").alias("e"))
    part = lambda i: F.regexp_extract("e.ref", "^([^#]+)#p([0-9]+)", i)
    evidence = e.select("query", F.col("e.kind").alias("kind"), filing_id(part(1)).alias("doc_id"), part(2).try_cast("int").alias("page"), none.alias("row"), none.alias("column")).distinct()
    return audit.grade_citations(cites, evidence)


def claim_holds(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks of a question's cited pages hold its recorded answer in some form."""
    c = chunks(spark, d).select("doc_id", F.explode("pages").alias("page"), "chunk_id", "text").where("text is not null")
    a = gold(spark, d).where("answer is not null").select(F.col("question_id").alias("query"), "answer")
    j = _targets(spark, d).join(c.withColumnRenamed("doc_id", "doc"), ["doc", "page"]).join(a, "query")
    return j.groupBy("query").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(supports("answer", "text")).alias("holding"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as lines of type: their first eighty characters in a size that follows from their place."""
    return chunks(spark, d).where("text is not null").select("doc_id", "chunk_id", F.substring("text", 1, 80).alias("text"), (9.0 + F.col("chunk_index") % 4).alias("size"))


def line_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The size of most characters of each filing, and the largest that is still body text."""
    return layout.body_sizes(_lines(spark, d))


def heading_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Sections of chunks that have the shape of a heading."""
    s = chunks(spark, d).select(F.explode("section_path").alias("section")).distinct()
    return s.select("section", layout.heading_shape(F.col("section")).alias("heading"))


QUERIES = {f.__name__: f for f in (free_blocks, captions_near, table_continuations, chart_figures, shaped_tables, table_texts, openapi_facts, reranked, lock_changes, gate_decisions, claimed_rates, graded_citations, claim_holds, line_sizes, heading_shapes)}

_K = f"(select b.chunk_id ord, b.doc_id, b.page, x0, y0, x1, y1, i, coalesce(list_contains(c.kinds, 'table'), false) is_table, coalesce(list_contains(c.kinds, 'caption'), false) is_caption from {_BOX} b join (select chunk_id, any_value(kinds) kinds, any_value(chunk_index) i from chunk where chunk_id is not null group by 1) c using (chunk_id))"
_SHEET = "(select company_code, period, line_id, account, case when \"value\" is null then ' ' when \"value\" % 1 <> 0 then format('{:,.2f}', cast(round_even(\"value\", 2) as double)) else format('{:,.0f}', cast(\"value\" as double)) end fig from fin_line_item where basis = 'consolidated' and company_code is not null and (\"value\" is null or abs(\"value\") < 1000000000000))"
_COVERS = "greatest(least(r.x1, k.x1) - greatest(r.x0, k.x0), 0) * greatest(least(r.y1, k.y1) - greatest(r.y0, k.y0), 0) >= 0.5 * (k.x1 - k.x0) * (k.y1 - k.y0) and (k.x1 - k.x0) * (k.y1 - k.y0) > 0"
_ONE = lambda c: f"translate({S.no_space(S.fold(c))}, '仟臺', '千台')"
_PAY = lambda c: f"replace({c}, ',', '')"
SQL = {
    "free_blocks": f"with k as {_K} select distinct ord, doc_id, page from k where not is_table and not exists (select 1 from k r where r.is_table and r.doc_id = k.doc_id and r.page = k.page and {_COVERS})",
    "captions_near": f"with k as {_K}, j as (select f.doc_id, f.page, f.ord, c.ord caption, greatest(c.y0 - f.y1, f.y0 - c.y1, 0) gap from k f join k c on f.doc_id = c.doc_id and f.page = c.page and not f.is_caption and c.is_caption where least(c.x1, f.x1) - greatest(c.x0, f.x0) > 0) select doc_id, page, ord, arg_min(caption, (gap, caption)) caption from j where gap <= {G.CAPTION} group by all",
    "table_continuations": f"with t as (select doc_id, page, ord, i % 2 n, y0 / {HEIGHT} y0, y1 / {HEIGHT} y1 from {_K} where is_table) select doc_id, page, ord, case when y0 <= 0.25 and exists (select 1 from t p where p.doc_id = t.doc_id and p.page = t.page - 1 and p.n = t.n and p.y1 >= 0.6) then page - 1 end continues_from_page from t",
    "chart_figures": f"""with k as {_K}, f as (select *, x1 - x0 w, y1 - y0 h from k where not is_table), s as (select * from f where w > 0 and h > 0 and w * h / {AREA} between {G.AREA[0]} and {G.AREA[1]} and greatest(w / h, h / w) <= {G.ASPECT}), u as (select * from s k where not exists (select 1 from (select * from {_K} where is_table) r where r.doc_id = k.doc_id and r.page = k.page and {_COVERS})),
w as (select doc_id, page, x0 + i.i wx, y0 wy from {_K} cross join (values (0), (1), (2)) i(i)) select u.doc_id, u.page, u.ord, count(*) numeric_labels from u join w on u.doc_id = w.doc_id and u.page = w.page and wx >= x0 - {G.MARGIN} and wx + 1 <= x1 + {G.MARGIN} and wy >= y0 - {G.MARGIN} and wy + 1 <= y1 + {G.MARGIN} group by all having count(*) >= {G.LABELS}""",
    "shaped_tables": f"with s as (select company_code, period, count(*) n, count_if(length(trim(coalesce(account, ''), ' ')) > 0) + count_if(fig <> ' ') filled, count_if(fig <> ' ') num from {_SHEET} group by all) select company_code, period, cast(n as integer) n_rows, 2 n_cols, cast(2 * n as integer) cells, cast(num as integer) numeric_cells, round(filled / (2 * n), 6) fill, n >= 2 and filled >= 4 and filled / (2 * n) >= 0.3 and num >= 1 is_table from s",
    "table_texts": f"select company_code, period, '單位：千元' || chr(10) || string_agg(coalesce(account, '') || ' | ' || fig, chr(10) order by line_id) text from {_SHEET} group by all",
    "openapi_facts": "with f as (select company_code, period, account, max(\"value\") v from fin_line_item where basis = 'consolidated' and company_code is not null and regexp_matches(period, '^FY[0-9]{4}(Q[1-4])?$') group by all) select company_code, period, trim(case when account like '營業%' then account else regexp_replace(account, '\\s*[(（]((?:新?[臺台]幣)?(?:百萬|十億|億|萬|千|仟)?元|%|％|倍|千股|仟股|股)[)）]\\s*$', '') end) account, case when account like '營業%' then '百萬元' when regexp_extract(account, '[(（]((?:新?[臺台]幣)?(?:百萬|十億|億|萬|千|仟)?元|%|％|倍|千股|仟股|股)[)）]\\s*$', 1) <> '' then regexp_extract(account, '[(（]((?:新?[臺台]幣)?(?:百萬|十億|億|萬|千|仟)?元|%|％|倍|千股|仟股|股)[)）]\\s*$', 1) else '千元' end unit, v \"value\" from f where v is not null",
    "reranked": f"with h as (select query, chunk_id, rank before, length(chunk_id) % 3 s from {_HITS('lexical')}), r as (select query, chunk_id, before, cast(row_number() over (partition by query order by s desc, before) as integer) rank from h) select * from r where rank <= 5",
    "lock_changes": "with f as (select distinct doc_id, doc_type, fiscal_year, pages from filing) select doc_id, case when fiscal_year = 2020 then 'ADDED' when doc_type = 'xbrl' then 'MISSING' when doc_type = 'annual_report' and pages is not null then 'CHANGED' else 'OK' end status from f where not (fiscal_year = 2020 and doc_type = 'xbrl')",
    "gate_decisions": "select 'G' || i gate, i <> 10 passed, 'CONDITIONAL_GO' decision from range(1, 11) t(i)",
    "claimed_rates": "select * from (values ('table_cell', 'mismatch'), ('cross_page', 'missing'), ('ghost', 'unsupported')) t(question_type, kind)",
    "graded_citations": f"""with g as (select question_id query, answerable, required_evidence from (select question_id, any_value(answerable) answerable, any_value(required_evidence) required_evidence from gold where question_id is not null group by 1)), c as (select h.query, h.doc, h.pages[1] page, not answerable refused from {_HITS('rerank')} h join g using (query) where rank <= 3),
e as (select distinct query, x.kind kind, {S.filing_id("regexp_extract(x.ref, '^([^#]+)#p([0-9]+)', 1)")} doc, try_cast(regexp_extract(x.ref, '^([^#]+)#p([0-9]+)', 2) as integer) page from (select query, unnest(required_evidence) x from g)),
p as (select query, count(doc) cited, bool_or(refused) refused from c group by 1), m as (select c.query, count(distinct (e.kind, e.doc, e.page)) met from c join e on c.query = e.query and c.doc = e.doc and c.page = e.page group by 1) select query, cited, coalesce(met, 0) met, case when not refused then coalesce(met, 0) > 0 end valid from p left join m using (query)""",
    "claim_holds": f"""with t as {_TARGETS}, c as (select doc_id doc, unnest(pages) page, text from {S.CHUNKS}), j as (select t.query, {_ONE('c.text')} e, {_ONE('g.answer')} a from t join c using (doc, page) join {S.GOLD} g on g.question_id = t.query where c.text is not null and g.answer is not null), s as (select query, e, a, regexp_extract_all({_PAY('a')}, '[0-9][0-9.]+|[A-Za-z]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') atoms from j)
select query, count(*) chunks, count_if(contains(e, a) or contains({_PAY('e')}, {_PAY('a')}) or (len(atoms) > 0 and len(list_filter(atoms, lambda x: not contains({_PAY('e')}, x))) = 0)) holding from s group by query""",
    "line_sizes": f"""with l as (select doc_id, round(9.0 + i % 4, 1) size, length({S.no_space('substring(text, 1, 80)')}) n from (select any_value(doc_id) doc_id, any_value(chunk_index) i, any_value(text) text from chunk where chunk_id is not null group by chunk_id) where text is not null), s as (select doc_id, cast(size as double) size, sum(n) n from l group by all), a as (select *, sum(n) over (partition by doc_id) al from s)
select doc_id, arg_max(size, (n, -size)) dominant, coalesce(max(case when n >= 0.03 * al and n >= 2000 then size end), arg_max(size, (n, -size))) ceiling from a group by doc_id""",
    "heading_shapes": f"select distinct section, length(trim(section, ' ')) > 0 and length(trim(section, ' ')) <= {layout.MAX_HEADING} and not regexp_matches(trim(section, ' '), '[。；！？]$') and len(regexp_extract_all(regexp_replace(trim(section, ' '), '^[0-9.]+', ''), '[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+\\.[0-9]+')) <= 1 heading from (select unnest(section_path) section from {S.CHUNKS})",
}
