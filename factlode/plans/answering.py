"""Queries from a question to its graded answer: figures, dispatch, the ladder, scope, tests between systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.functions import fields as R
from factlode.functions.keys import company_code
from factlode.functions.text import is_refusal
from factlode.operators import answering as A, answers, facts as X, fusion, gates, questions as Q, scope, scoring
from factlode.plans import sqltext as S
from factlode.plans.evaluation import _ACC, _R, _ROUTE, _UNIQ
from factlode.plans.retrieval import _HITS, _TARGETS, _hits, _targets, gold
from factlode.plans.structure import SQL as _STRUCTURE
from factlode.runtime import load

MODES = ("lexical", "dense", "rerank", "citation_prior")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("question_id", company_code(F.col("company.code")).alias("company_code"), "question", "statement_basis")


def numeric_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every question put to the fact store: its figure with operands and sources, or the status that says why there is none."""
    return A.answer_numerically(_asked(spark, d), load(spark, d, "fin_line_item"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Questions with what each path has to say: the store's figure, a reply about the chart, and a reply in the answer's form."""
    figures = numeric_answers(spark, d).select("question_id", F.when(F.col("status") == "OK", F.col("answer")).alias("figure"), F.col("unit").alias("figure_unit"), F.when(F.col("status") == "OK", F.col("period")).alias("figure_period"))
    g = gold(spark, d)
    blank = lambda c: F.coalesce(c, F.lit("無"))
    chart = F.when(F.col("question_type") == "chart_value_trend", R.chart_reply(F.format_string("數值：%s\n單位：%s\n依據：圖", F.coalesce("answer", F.lit(R.UNREADABLE)), blank(F.col("unit")))))
    reply = F.format_string("答案：%s\n單位：%s\n期間：%s\n依據：[1]", F.coalesce("answer", F.lit("文件中沒有")), blank(F.col("unit")), blank(F.col("period")))
    g = g.select("question_id", "question_type", "answerable", Q.route(F.col("question")).alias("route"), chart.alias("c"), reply.alias("reply"))
    return g.join(figures, "question_id", "left").select("*", F.col("c.value").alias("chart_value"), F.col("c.unit").alias("chart_unit")).drop("c")


def dispatched(spark: SparkSession, d: str) -> DataFrame:
    """The answer that stands for each question when routes are committed."""
    return A.dispatch(_paths(spark, d), F.lit(True)).select("question_id", "route", "handled_route", "said", "said_unit", "said_period")


def _met(spark: SparkSession, d: str) -> DataFrame:
    """Whether the five best of each mode cover a place that the question's evidence names: query, mode, met."""
    t = _targets(spark, d)
    hybrid = fusion.fuse(load(spark, d, "hit").where("retriever in ('lexical', 'dense')"), "question_id", "chunk_id", "retriever", "rank", top_k=5).select("query", F.col("item").alias("chunk_id"), "rank")
    places = load(spark, d, "hit").groupBy("chunk_id").agg(F.first("doc_id").alias("doc"), F.first("pages").alias("pages"))
    hits = {"lexical": _hits(spark, d, "lexical"), "rerank": _hits(spark, d, "rerank"), "hybrid": hybrid.join(places, "chunk_id")}
    out = None
    for mode, h in hits.items():
        m = fusion.retrieval_metrics(h.select("query", "rank", "doc", "pages"), t).select("query", F.lit(mode).alias("mode"), F.col("recall").alias("met"))
        out = m if out is None else out.unionAll(m)
    return out


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """Every question on every rung, F0 to F7."""
    return A.climb(_paths(spark, d), _met(spark, d))


def ladder_summary(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, citations, routes and refusals of every rung with their denominators."""
    g = gold(spark, d)
    steps = ladder(spark, d).withColumn("row", F.concat_ws("|", "factor", "question_id"))
    asked = g.select("question_id", "question_type", "answer", "acceptable_variants", "unit", "period", "tolerance", "answerable")
    said = steps.join(asked, "question_id").select(F.col("row").alias("question_id"), "answer", "acceptable_variants", "unit", "period", "tolerance", "answerable", F.col("said").alias("predicted"), F.col("said_unit").alias("predicted_unit"), F.col("said_period").alias("predicted_period"))
    correct = scoring.score_answers(said).select(F.col("question_id").alias("row"), "correct")
    graded = steps.join(correct, "row").join(asked.select("question_id", F.col("question_type").alias("category"), "answerable", Q.effective_route(F.col("question_type")).alias("gold_route")), "question_id")
    return A.summary(graded, ["factor"])


def company_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The companies that each question names; null codes where it names none."""
    s = scope.company_scope(gold(spark, d), load(spark, d, "company"))
    return s.select("question_id", F.array_join("codes", ",").alias("codes"))


def scoped_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits kept to the filings of the companies that the wording names, then fused: the ten best of each question."""
    s = scope.company_scope(gold(spark, d), load(spark, d, "company"))
    docs = load(spark, d, "filing").select("doc_id", company_code(F.col("company.code")).alias("code"))
    kept = scope.within_scope(load(spark, d, "hit").select("question_id", "retriever", "chunk_id", "rank", "doc_id"), s, docs, "question_id")
    return fusion.fuse(kept, "question_id", "chunk_id", "retriever", "rank", top_k=10)


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 5 of every retriever on the questions it returned hits for: query, system, recall."""
    t, out = _targets(spark, d), None
    for r in MODES:
        h = _hits(spark, d, r)
        m = fusion.retrieval_metrics(h, t.join(h.select("query").distinct(), "query", "left_semi")).select("query", F.lit(r).alias("system"), "recall")
        out = m if out is None else out.unionAll(m)
    return out


def mode_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every two retrievers against each other, with the threshold shared out over all pairs."""
    return gates.pairwise_tests(_outcomes(spark, d), "query", "system", "recall")


def pooled_gains(spark: SparkSession, d: str) -> DataFrame:
    """Percentage points that reranking gains over the lexical ranking on the computed categories, pooled over items."""
    o = _outcomes(spark, d).join(gold(spark, d).select(F.col("question_id").alias("query"), "question_type"), "query")
    return gates.pooled_gain(o, "system", "question_type", ["numeric_calculation", "cross_period_comparison"], F.col("recall"), "lexical", "rerank").select(F.round("gain", 6).alias("gain"))


def refusal_checks(spark: SparkSession, d: str) -> DataFrame:
    """Refusals of the committed answers against the questions that call for one."""
    said = dispatched(spark, d).select("question_id", is_refusal(F.col("said")).alias("refused"))
    return gates.refusal_rates(said.join(gold(spark, d).select("question_id", (~F.col("answerable")).alias("should_refuse")), "question_id"))


def rank_falls(spark: SparkSession, d: str) -> DataFrame:
    """Ranks at which a retriever meets fewer places than at the rank before."""
    t, out = _targets(spark, d), None
    for r in MODES:
        m = fusion.evidence_hits(_hits(spark, d, r), t).where("rank <= 20").groupBy("rank").agg(F.count(F.lit(1)).alias("met")).select(F.lit(r).alias("retriever"), "rank", "met")
        out = m if out is None else out.unionAll(m)
    return gates.falls(out, ["retriever"], "rank", "met")


def heading_periods(spark: SparkSession, d: str) -> DataFrame:
    """The single fiscal year that a question's wording names as a heading would."""
    return gold(spark, d).select("question_id", R.heading_period(F.col("question")).alias("period"))


def account_statements(spark: SparkSession, d: str) -> DataFrame:
    """Accounts by the statement they are filed under and the one they are known to belong to."""
    f = load(spark, d, "fin_line_item").groupBy("account", "statement").agg(F.count(F.lit(1)).alias("n"))
    return f.select("account", "statement", R.statement_of(F.col("account")).alias("known"), "n")


def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("question_id", R.longest_figure(F.col("answer")).alias("key")).where("key is not null")


def figure_forms(spark: SparkSession, d: str) -> DataFrame:
    """Figures as filings print them and as answers state them."""
    v = load(spark, d, "fin_line_item").select("value").where("abs(value) < 1000000000000").distinct()
    return v.select("value", scoring.figure_text(F.col("value")).alias("printed"), scoring.amount_text(F.col("value")).alias("stated"))


def citations_checked(spark: SparkSession, d: str) -> DataFrame:
    """The passages that the first and the ninth citation of every question name."""
    a = gold(spark, d).select(F.col("question_id").alias("query"), answers.parse_answer(F.concat(F.lit("答案：x\n依據：[1]、[9]"), F.coalesce("answer", F.lit("")))).alias("p")).select("query", F.filter("p.citations", lambda c: c.isin(1, 9)).alias("citations"))
    h = _hits(spark, d, "rerank").select("query", "rank", F.col("doc").alias("doc_id"), "pages")
    return answers.valid_citations(a, h.dropDuplicates(["query", "rank"])).select("query", "citation", "valid")


def evidence_crops(spark: SparkSession, d: str) -> DataFrame:
    """The first three pieces of evidence of each question in their order."""
    e = gold(spark, d).select("question_id", F.posexplode(F.slice("required_evidence", 1, 3)).alias("i", "e"))
    return e.select("question_id", (F.col("i") + 1).alias("place"), F.col("e.kind").alias("kind"), F.col("e.ref").alias("ref"))


def parsed_proportions(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each question type through their JSON form."""
    g = gold(spark, d).groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("audited").alias("correct"))
    p = R.proportion(F.to_json(F.struct("n", "correct")))
    return g.select("question_type", p["n"].alias("n"), p["k"].alias("k"), p["problem"].alias("problem"))


QUERIES = {f.__name__: f for f in (numeric_answers, dispatched, ladder, ladder_summary, company_scopes, scoped_hits, mode_tests, pooled_gains, refusal_checks, rank_falls, heading_periods, account_statements, answer_keys, figure_forms, citations_checked, evidence_crops, parsed_proportions)}

_PERIOD = "case when regexp_extract(question, '(?i)FY([0-9]{4})', 1) <> '' then" + _STRUCTURE["question_years"].split("then", 1)[1].split(" end period")[0] + " end"
_KIND = f"case when len({_UNIQ}) = 0 then null when {_R('佔|占|比率|比重|占比')} and len({_UNIQ}) >= 2 then 'ratio' when {_R('分別|(?:是多少.*){2,}')} then null when {_R('成長|增減|變動|年增|較.*(?:增加|減少)')} then case when {_R('比例|比率|率|幅度|百分比|成長|年增')} then 'growth' else 'delta' end else 'lookup' end"
_CANON = "case account " + " ".join(f"when '{s}' then '{a}'" for a, ss in Q.ACCOUNTS.items() for s in ss) + " end"
_PLACES = lambda v: f"regexp_replace(format('{{:,.2f}}', cast(round_even({v}, 2) as double)), '[.]?0+$', '')"
_UNIT = lambda c: S.canonical_unit(c)
_PCT = lambda a, b: f"cast(round(cast({a} as decimal(24,6)) * 100 / cast({b} as decimal(24,6)), 2) as decimal(38,6))"
_NUMERIC = f"""(with q as (select question_id, {S.company_code('company.code')} code, coalesce(statement_basis, 'consolidated') basis, {_UNIQ} accs, {_KIND} kind, {_PERIOD} period from (select question_id, any_value(question) question, any_value(company) company, any_value(statement_basis) statement_basis from gold where question_id is not null group by question_id)),
p as (select *, accs[1] a1, case when kind = 'ratio' then accs[2] when kind in ('growth', 'delta') then accs[1] end a2, case when kind in ('growth', 'delta') then 'FY' || (cast(substring(period, 3, 4) as integer) - 1) else period end p2 from q),
k as (select *, {_CANON} acc from fin_line_item), u as (select * from k where acc is not null qualify row_number() over (partition by company_code, period, statement, basis, acc, source_kind, source_ref order by loaded_at desc, line_id desc) = 1),
f as (select company_code code, acc, period, basis, count(*) n, any_value("value") v, any_value(unit) unit, any_value(currency) cur, any_value(unit_is_uniform) uni, any_value(company_code || ' ' || period || ' ' || acc || ' [' || source_kind || ':' || source_ref || ']') ref from u group by all),
j as (select p.*, x.n n1, x.v v1, {_UNIT('x.unit')} u1, x.cur c1, x.uni i1, x.ref r1, y.n n2, y.v v2, {_UNIT('y.unit')} u2, y.cur c2, y.uni i2, y.ref r2 from p left join f x on x.code = p.code and x.basis = p.basis and x.acc = p.a1 and x.period = p.period left join f y on y.code = p.code and y.basis = p.basis and y.acc = p.a2 and y.period = p.p2),
s as (select *, case when code is null or period is null or kind is null then 'unparsed' when n1 is null or (a2 is not null and n2 is null) then 'no_figure' when n1 > 1 or (a2 is not null and n2 > 1) then 'ambiguous' when a2 is null then case when v1 is null then 'no_value' else 'OK' end
when v1 is null or v2 is null then 'no_value' when not i1 or not i2 then 'unit_not_uniform' when u1 is null or u2 is null then 'no_unit' when c1 is distinct from c2 then 'currency' when u1 <> u2 then 'scale' when v2 = 0 and kind = 'ratio' then 'zero_denominator' when v2 = 0 and kind = 'growth' then 'zero_base' else 'OK' end status from j),
o as (select *, case when status = 'OK' then case kind when 'lookup' then v1 when 'delta' then cast(v1 - v2 as decimal(38,6)) when 'ratio' then {_PCT('v1', 'v2')} else {_PCT('(v1 - v2)', 'v2')} end end val from s)
select question_id, kind, period, val "value", case when status = 'OK' then case when kind in ('lookup', 'delta') then u1 else '%' end end unit, case when status = 'OK' then case kind when 'lookup' then a1 when 'delta' then a1 || ' ' || period || ' - ' || p2 when 'ratio' then a1 || ' / ' || a2 || ' * 100' else a1 || ' (' || period || ' - ' || p2 || ') / ' || p2 || ' * 100' end end formula,
case when status = 'OK' then a1 || ' ' || period || '=' || v1 || case when a2 is not null then '; ' || a2 || ' ' || p2 || '=' || v2 else '' end end operands, case when status = 'OK' then r1 || case when a2 is not null then '; ' || r2 else '' end end source_refs, status, case when val is null then '{A.REFUSED}' else {_PLACES('val')} end answer from o)"""
_NONE = lambda c: f"case when trim({c}) in ('', '無', '無。') then null else trim({c}) end"
_DISPATCH = f"""(with n as {_NUMERIC}, g as (select question_id, question_type, answerable, {_ROUTE} route, coalesce(answer, '文件中沒有') said0, unit unit0, period period0, case when question_type = 'chart_value_trend' and trim(coalesce(answer, '{R.UNREADABLE}')) not in ('', '{R.UNREADABLE}') then trim(answer) end cv, case when question_type = 'chart_value_trend' then case when trim(unit) in ('', '無') then null else trim(unit) end end cu from {S.GOLD})
select g.*, case when n.status = 'OK' then n.answer end fig, n.unit fu, n.period fp from g left join n using (question_id))"""
_SAID = lambda fig, cv, ref: f"case when {fig} is not null then {fig} when {cv} is not null then {cv} when {ref} then '{A.REFUSED}' else trim(said0) end"
_REF = lambda c: "(" + " or ".join(f"contains(lower({S.no_space(S.fold(c))}), '{r}')" for r in _refusals()) + ")"


def _refusals() -> list[str]:
    from factlode.functions.text import REFUSALS

    return REFUSALS


_RUNGS = "(values " + ", ".join(f"('{f}', '{m}', {n}, {c}, {t})" for f, _, m, n, c, t in A.LADDER) + ") l(factor, mode, num, cha, com)"
_MET = f"""(with t as {_TARGETS}, place as (select chunk_id, any_value(doc_id) doc, any_value(pages) pages from hit group by 1), ff as (select question_id query, retriever, chunk_id, min(rank) pos from hit where retriever in ('lexical', 'dense') group by all), pp as (select *, row_number() over (partition by query, retriever order by pos, chunk_id) k from ff),
ss as (select query, chunk_id, round(sum(1.0 / (60 + k)), 9) sc from pp group by all), hy as (select query, chunk_id, row_number() over (partition by query order by sc desc, chunk_id) rank from ss),
h as (select 'lexical' mode, query, rank, doc, pages from {_HITS('lexical')} union all select 'rerank', query, rank, doc, pages from {_HITS('rerank')} union all select 'hybrid', query, rank, doc, pages from hy join place using (chunk_id) where rank <= 5),
b as (select mode, query, min(rank) first from (select mode, query, rank, doc, unnest(pages) page from h) join t using (query, doc, page) group by all)
select m.mode, w.query, coalesce(b.first, 99) <= 5 met from (select distinct query from t) w cross join (values ('lexical'), ('rerank'), ('hybrid')) m(mode) left join b on b.query = w.query and b.mode = m.mode)"""
_OUT = "(" + " union all ".join(f"select * from (with t as {_TARGETS} select t.query, '{r}' system, coalesce(min(h.rank), 99) <= 5 ok from t semi join {_HITS(r)} s on s.query = t.query left join (select query, rank, doc, unnest(pages) page from {_HITS(r)}) h on h.query = t.query and h.doc = t.doc and h.page = t.page group by t.query)" for r in MODES) + ")"
_MC = "round(case when a + b = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, cast(least(a, b) as bigint) + 1), lambda i: exp(lgamma(a + b + 1.0) - lgamma(i + 1.0) - lgamma(a + b - i + 1.0) + (a + b) * ln(0.5))))) end, 9)"
_SCOPES = f"(select g.question_id, list_sort(list_distinct(list(c.code) filter (c.code is not null))) codes from {S.GOLD} g left join company c on contains(g.question, c.name) or list_contains(regexp_extract_all(g.question, '[0-9]+'), c.code) group by 1)"
_FLAT = S.no_space("question")
_YEAR = "coalesce(" + ", ".join(f"nullif(regexp_extract({_FLAT}, '{p}', 1), '')" for p in R.YEARS) + ")"
SQL = {
    "numeric_answers": f"select * from {_NUMERIC}",
    "dispatched": f"select question_id, route, case when fig is not null then 'numeric' when cv is not null then 'chart' else route end handled_route, {_SAID('fig', 'cv', "route in ('numeric', 'chart')")} said, case when fig is not null then fu when cv is not null then cu when route not in ('numeric', 'chart') then {_NONE('unit0')} end said_unit, case when fig is not null then fp when cv is not null then null when route not in ('numeric', 'chart') then {_NONE('period0')} end said_period from {_DISPATCH}",
    "ladder": f"""with g as (select d.* exclude (fig, cv), l.*, case when num then fig end f, case when cha then cv end c from {_DISPATCH} d cross join {_RUNGS}), s as (select *, {_SAID('f', 'c', "com and route in ('numeric', 'chart')")} said, case when f is not null then 'numeric' when c is not null then 'chart' when com then route else 'narrative' end handled_route,
case when f is not null then fu when c is not null then cu when not (com and route in ('numeric', 'chart')) then {_NONE('unit0')} end said_unit, case when f is not null then fp when c is not null then null when not (com and route in ('numeric', 'chart')) then {_NONE('period0')} end said_period from g), r as (select *, {_REF('said')} refused from s)
select question_id, factor, r.mode, case when refused then 'unanswerable' else route end route, handled_route, said, said_unit, said_period, refused, case when not refused then met end cited_ok from r left join {_MET} m on m.query = r.question_id and m.mode = r.mode""",
    "company_scopes": f"select question_id, array_to_string(codes, ',') codes from {_SCOPES}",
    "scoped_hits": f"""with s as {_SCOPES}, fd as (select doc_id, {S.company_code('company.code')} code from filing), al as (select distinct question_id, doc_id from (select question_id, unnest(codes) code from s) join fd using (code)), h as (select hit.* from hit semi join al on al.question_id = hit.question_id and al.doc_id = hit.doc_id union all select hit.* from hit anti join (select question_id from s where codes is not null) z on z.question_id = hit.question_id),
f as (select question_id query, retriever, chunk_id item, min(rank) pos from h group by all), p as (select *, row_number() over (partition by query, retriever order by pos, item) place from f), t as (select query, item, round(sum(1.0 / (60 + place)), 9) score, cast(count(*) as integer) sources from p group by all), r as (select *, cast(row_number() over (partition by query order by score desc, item) as integer) rank from t) select * from r where rank <= 10""",
    "mode_tests": f"with o as {_OUT}, c as (select a.system \"left\", b.system \"right\", count(*) n, count_if(a.ok and not b.ok) a, count_if(not a.ok and b.ok) b from o a join o b on a.query = b.query and a.system < b.system group by all), r as (select *, {_MC} p from c) select \"left\", \"right\", n, cast(a as bigint) only_left, cast(b as bigint) only_right, p, p < 0.05 / count(*) over () significant from r",
    "pooled_gains": f"with o as {_OUT}, g as (select o.*, question_type from o join {S.GOLD} g on g.question_id = o.query where question_type in ('numeric_calculation', 'cross_period_comparison')) select round(100.0 * count_if(system = 'rerank' and ok) / count_if(system = 'rerank') - 100.0 * count_if(system = 'lexical' and ok) / count_if(system = 'lexical'), 6) gain from g",
    "refusal_checks": f"with d as (select answerable, {_SAID('fig', 'cv', "route in ('numeric', 'chart')")} said from {_DISPATCH}), r as (select {_REF('said')} refused, not answerable should from d) select count_if(refused) refused, count_if(should) should_refuse, count_if(refused and should) correct_refusals, round(count_if(refused and should) / count_if(refused), 4) \"precision\", round(count_if(refused and should) / count_if(should), 4) recall from r",
    "rank_falls": "with " + f"t as {_TARGETS}, m as (" + " union all ".join(f"select '{r}' retriever, rank, count(*) met from (select distinct query, rank, doc, page from (select query, rank, doc, unnest(pages) page from {_HITS(r)}) join t using (query, doc, page) where rank <= 20) group by rank" for r in MODES) + "), w as (select retriever, lag(rank) over (partition by retriever order by rank) before, rank cutoff, lag(met) over (partition by retriever order by rank) correct_before, met correct from m) select * from w where correct < correct_before",
    "heading_periods": f"select question_id, case when not regexp_matches({_FLAT}, '{R.SPANS}') and {_YEAR} is not null then 'FY' || (cast({_YEAR} as integer) + 1911) end period from {S.GOLD}",
    "account_statements": "select account, statement, case trim(account, ' ') " + " ".join(f"when '{a}' then '{s}'" for s, xs in R.STATEMENTS.items() for a in xs) + " end known, count(*) n from fin_line_item group by all",
    "answer_keys": f"with f as (select question_id, regexp_extract_all(answer, '[0-9][0-9,]*(?:[.][0-9]+)?') x from {S.GOLD}) select question_id, list_filter(x, lambda y: length(y) = list_max(list_transform(x, lambda z: length(z))))[1] key from f where len(x) > 0",
    "figure_forms": f"select distinct \"value\", case when \"value\" % 1 <> 0 then format('{{:,.2f}}', cast(round_even(\"value\", 2) as double)) else format('{{:,.0f}}', cast(\"value\" as double)) end printed, {_PLACES('\"value\"')} stated from fin_line_item where abs(\"value\") < 1000000000000",
    "citations_checked": f"with h as (select distinct query, rank from {_HITS('rerank')}), a as (select question_id query, unnest([1, 9]) citation from {S.GOLD}) select a.query, cast(a.citation as integer) citation, h.rank is not null valid from a left join h on h.query = a.query and h.rank = a.citation",
    "evidence_crops": "with g as (select question_id, any_value(required_evidence) r from gold where question_id is not null group by 1), e as (select question_id, unnest(range(1, len(r) + 1)) i, unnest(r) e from g) select question_id, cast(i as integer) place, e.kind kind, e.ref \"ref\" from e where i <= 3",
    "parsed_proportions": f"select question_type, count(*) n, cast(count_if(audited) as bigint) k, cast(null as varchar) problem from {S.GOLD} group by 1",
}
