"""Queries over the question sets: routes, rates, tests, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.functions.keys import company_code, filing_id
from factlode.functions.text import answer_atoms, characters_of, jaccard, gram_set
from factlode.operators.audit import audit_sample, leakage
from factlode.operators import fusion, gates, pages, questions as Q, scoring, validate as V
from factlode.plans import sqltext as S
from factlode.plans.retrieval import _NEAR, _TARGETS, _hits, _targets, gold
from factlode.runtime import load


def wilson_by_type(spark: SparkSession, d: str) -> DataFrame:
    return gates.proportions(gold(spark, d), ["question_type"], "audited", "answerable")


def rates_by_set(spark: SparkSession, d: str) -> DataFrame:
    """Answerable questions overall, per set, and per set and type, in one pass."""
    g = gold(spark, d).groupingSets([["question_set"], ["question_set", "question_type"], []], "question_set", "question_type").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("answerable"))
    return g.withColumn("rate", F.round(F.col("answerable") / F.col("n"), 6))


def paired_recall(spark: SparkSession, d: str) -> DataFrame:
    """Lexical against dense: recall at 5 on the questions both returned hits for."""
    t, both = _targets(spark, d), None
    for r in ("lexical", "dense"):
        h = _hits(spark, d, r)
        seen = h.select("query").distinct()
        m = fusion.retrieval_metrics(h, t.join(seen, "query", "left_semi")).select("query", F.lit(r).alias("system"), "recall")
        both = m if both is None else both.unionAll(m)
    return gates.paired_test(both, "query", "system", "lexical", "dense", "recall")


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank 95th percentile and upper median of event values by type."""
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.expr("percentile_disc(0.5) within group (order by value desc)").alias("upper_median"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select("question_id", Q.route(F.col("question")).alias("route"), Q.confidence(F.col("question")).alias("confidence"))


def route_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the route of their type and the route of their wording."""
    g = gold(spark, d).select(Q.effective_route(F.col("question_type")).alias("gold_route"), Q.route(F.col("question")).alias("route"))
    return g.groupBy("gold_route").pivot("route", ["metadata", "chart", "cross_modal", "numeric", "narrative"]).count().na.fill(0)


def numeric_questions(spark: SparkSession, d: str) -> DataFrame:
    """What each question asks of the fact store: company, years, accounts and kind."""
    g = gold(spark, d)
    return g.select("question_id", company_code(F.col("company.code")).alias("company_code"), F.concat_ws(",", Q.periods(F.col("question")).cast("array<string>")).alias("years"), F.concat_ws(",", Q.accounts(F.col("question"))).alias("accounts"), Q.numeric_kind(F.col("question")).alias("kind"))


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each question answered with the recorded answer of its first variant, unit stated."""
    g = gold(spark, d).select("question_id", "answer", "acceptable_variants", "unit", "period", "tolerance", "answerable", F.coalesce(F.get("acceptable_variants", F.lit(0)), F.col("answer"), F.lit("文件中沒有")).alias("predicted"), F.col("unit").alias("predicted_unit"), F.col("period").alias("predicted_period"))
    return scoring.score_answers(g)


def tolerance_defaults(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d)
    t = scoring.default_tolerance(F.col("unit"))
    return g.select("question_id", F.coalesce(F.col("tolerance.type"), t["type"]).alias("type"), F.coalesce(F.col("tolerance.value"), t["value"]).alias("value"))


def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    return V.gold_problems(load(spark, d, "gold"))


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicates(load(spark, d, "gold"), ["question_id"])


def repeated_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of equal wording under several ids."""
    return V.duplicates(gold(spark, d), ["question"])


def composition(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).groupBy("question_set").agg(F.count(F.lit(1)).alias("n"), F.count_if("answerable").alias("answerable"), F.count_if(F.col("question_type") == "unanswerable").alias("unanswerable"), F.count_if("audited").alias("audited"), F.count_distinct("company.code").alias("codes"), F.count_if(F.size("source_document") > 1).alias("several_documents"))


def filing_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Filings that questions cite and the manifest lacks, and the other way."""
    cited = gold(spark, d).select(F.explode(F.transform("source_document", filing_id)).alias("doc_id"))
    return V.coverage(cited, load(spark, d, "filing"), "doc_id")


def shared_companies(spark: SparkSession, d: str) -> DataFrame:
    """Companies on both sides of the split of the manifest and of the question sets."""
    g = gold(spark, d).select(company_code(F.col("company.code")).alias("code"), F.col("question_set").isin("dev", "challenger").alias("training")).where("code is not null")
    both = g.where("training").select("code").intersect(g.where("not training").select("code"))
    return both.join(g, "code").groupBy("code").agg(F.count_if("training").alias("training"), F.count_if(~F.col("training")).alias("evaluation"))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "filing").groupBy("split", "doc_type").agg(F.count(F.lit(1)).alias("filings"), F.count_if(F.col("pages").isNull()).alias("without_pages"), F.sum("pages").alias("pages"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))


def evidence_places(spark: SparkSession, d: str) -> DataFrame:
    """Required evidence as document, page and locator."""
    e = load(spark, d, "gold").dropDuplicates(["question_id"]).select("question_id", F.posexplode("required_evidence").alias("i", "e"))
    part = lambda i: F.regexp_extract("e.ref", "^([^#]+)#p([0-9]+)(?:/(.*))?$", i)
    return e.select("question_id", "i", F.col("e.kind").alias("kind"), part(1).alias("doc"), F.expr("try_cast(regexp_extract(e.ref, '^([^#]+)#p([0-9]+)', 2) as int)").alias("page"), part(3).alias("locator"))


def row_keys(spark: SparkSession, d: str) -> DataFrame:
    """Row keys of structured sources in their four parts; null parts where the form is another."""
    g = load(spark, d, "gold").dropDuplicates(["question_id"]).where("structured_source_key is not null").select("question_id", F.col("structured_source_key.row_key").alias("k"))
    p = F.split("k", r"\|")
    ok = (F.size(p) == 4) & F.get(p, F.lit(1)).rlike("^p[0-9]+$")
    return g.select("question_id", *[F.when(ok, F.get(p, F.lit(i))).alias(n) for i, n in ((0, "doc"), (2, "row"), (3, "column"))], F.when(ok, F.substring(F.get(p, F.lit(1)), 2, 10).cast("int")).alias("page"))


def worklist(spark: SparkSession, d: str) -> DataFrame:
    """For each filing and topic the two pages richest in figures that name it, with an excerpt and the statement headings."""
    from factlode.plans.pages import page_texts

    w = pages.worklist(page_texts(spark, d))
    at = F.transform("headings", lambda h: F.concat(h.heading, F.lit(":"), F.array_join(h.pages, ",")))
    return w.withColumn("page_headings", F.array_join("page_headings", "|")).withColumn("headings", F.array_join(at, ";"))


def error_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a question's record earns, counted: one question may have several."""
    g = gold(spark, d)
    labels = F.array_compact(F.array(F.when(F.col("period").isNull(), "no_period"), F.when(F.col("company.code").isNull(), "no_company"), F.when(F.size(F.coalesce("source_document", F.array().cast("array<string>"))) == 0, "no_source"), F.when(F.col("answer").isNull(), "no_answer"), F.when(~F.col("audited"), "not_audited")))
    return g.select(F.explode(labels).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks that stand on a question's cited pages hold its recorded answer."""
    from factlode.plans.retrieval import chunks

    t = _targets(spark, d)
    c = chunks(spark, d).select("doc_id", F.explode("pages").alias("page"), "text").where("text is not null")
    a = gold(spark, d).where("answer is not null").select(F.col("question_id").alias("query"), "answer")
    j = t.join(c.withColumnRenamed("doc_id", "doc"), ["doc", "page"]).join(a, "query")
    return j.groupBy("query").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.contains("text", F.col("answer"))).alias("verbatim"), F.max(characters_of(F.col("text"))).alias("longest"))


def variant_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How alike a recorded answer and its variants are (bigram Jaccard), and the atoms of the answer."""
    g = load(spark, d, "gold").dropDuplicates(["question_id"]).where("answer is not null").select("question_id", "answer", F.explode("acceptable_variants").alias("variant")).distinct()
    return g.select("question_id", "variant", F.round(jaccard(gram_set(F.col("answer")), gram_set(F.col("variant"))), 6).alias("similarity"), F.size(answer_atoms(F.col("answer"))).alias("atoms"))


def leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage(load(spark, d, "gold"))


def audit_picks(spark: SparkSession, d: str) -> DataFrame:
    return audit_sample(load(spark, d, "gold"))


QUERIES = {f.__name__: f for f in (leaks, audit_picks, wilson_by_type, rates_by_set, paired_recall, latency_p95, routes, route_confusion, numeric_questions, answer_scores, tolerance_defaults, gold_problems, repeated_ids, repeated_questions, composition, filing_coverage, shared_companies, manifest_counts, evidence_places, row_keys, worklist, error_buckets, claim_support, variant_similarity)}

_Z = 1.959963984540054
_WIL = lambda s: f"case when n > 0 then least(1.0, greatest(0.0, round((k/n + {_Z * _Z}/(2.0*n) {s} {_Z} * sqrt(k/n*(1-k/n)/n + {_Z * _Z}/(4.0*n*n))) / (1 + {_Z * _Z}/n), 6))) end"
_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all(' ' || question, '(?:FY([0-9]{4}))|(?:[^0-9]([0-9]{2,4})\s*年)'), lambda y: case when cast(regexp_extract(y, '([0-9]+)', 1) as integer) < 1000 then cast(regexp_extract(y, '([0-9]+)', 1) as integer) + 1911 else cast(regexp_extract(y, '([0-9]+)', 1) as integer) end)))"
_R = lambda p: f"regexp_matches(question, '{p}')"
_ROUTE = f"case when {_R(Q.METADATA)} then 'metadata' when {_R(Q.CHART)} then 'chart' when {_R(Q.CROSS)} then 'cross_modal' when len({_YEARS}) >= 2 then 'numeric' when {_R(Q.COMPUTED)} then 'numeric' when {_R(Q.PRINTED)} then 'chart' else 'narrative' end"
_SPELT = sorted(((s, a) for a, ss in Q.ACCOUNTS.items() for s in ss), key=lambda x: (-len(x[0]), x[0]))
_ACC = f"regexp_extract_all(regexp_replace(question, '[（(]\\s*每[^）)]{{1,30}}[）)]', '', 'g'), '({'|'.join(s for s, _ in _SPELT)})')"
_ACCS = f"list_transform({_ACC}, lambda s: case s {' '.join(f'''when '{s}' then '{a}' ''' for s, a in _SPELT)} end)"
_UNIQ = f"list_filter({_ACCS}, lambda x, i: list_position({_ACCS}, x) = i)"
_H = lambda r: f"(select question_id query, chunk_id, min(rank) rank, any_value(doc_id) doc, any_value(pages) pages from hit where retriever = '{r}' group by all)"
_REC = lambda r: f"(select t.query, coalesce(min(h.rank), 99) <= 5 ok from t semi join {_H(r)} s on s.query = t.query left join (select query, rank, doc, unnest(pages) page from {_H(r)}) h on h.query = t.query and h.doc = t.doc and h.page = t.page group by t.query)"
_E = "list_filter(coalesce(required_evidence, []), lambda e: {})"
SQL = {
    "leaks": _NEAR + f""", side as (select *, case when question_set in ('dev', 'challenger') then 1 else 2 end side from {S.GOLD}), q as (select class, list_distinct(list(side)) s from m join side on side.question_id = m.id group by class),
firm as (select {S.company_code('company.code')} k, side from side), doc as (select {S.filing_id('x')} k, side from (select side, unnest(source_document) x from side))
select 'company' kind, k key from firm where k is not null group by k having count(distinct side) = 2 union all select 'document', k from doc where k is not null group by k having count(distinct side) = 2 union all select 'question', class from q where len(s) = 2
union all select 'question', a.class || '|' || b.class from s a join s b on a.class < b.class join q x on x.class = a.class join q y on y.class = b.class where len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) >= 0.8 and len(list_distinct(x.s || y.s)) = 2""",
    "wilson_by_type": f"with g as (select question_type, count_if(answerable) n, count_if(answerable and audited) k from {S.GOLD} group by 1) select question_type, n, k, case when n > 0 then round(k / n, 6) end rate, {_WIL('-')} low, {_WIL('+')} high from g",
    "rates_by_set": f"select question_set, question_type, cast(grouping(question_set, question_type) as integer) level, count(*) n, count_if(answerable) answerable, round(count_if(answerable) / count(*), 6) rate from {S.GOLD} group by grouping sets ((question_set), (question_set, question_type), ())",
    "paired_recall": f"with t as {_TARGETS}, a as {_REC('lexical')}, b as {_REC('dense')}, c as (select count(*) n, cast(count_if(not a.ok and b.ok) as bigint) gained, cast(count_if(a.ok and not b.ok) as bigint) lost from a join b using (query)) select 'lexical' baseline, 'dense' candidate, n, gained, lost, round(case when gained + lost = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, cast(least(gained, lost) as bigint) + 1), lambda i: exp(lgamma(gained + lost + 1.0) - lgamma(i + 1.0) - lgamma(gained + lost - i + 1.0) + (gained + lost) * ln(0.5))))) end, 9) p from c",
    "latency_p95": "select event_type, count(*) n, quantile_disc(\"value\", 0.95) p95, list_sort(list(\"value\"))[count(*) // 2 + 1] upper_median from events group by event_type",
    "routes": f"with r as (select question_id, question, {_ROUTE} route from {S.GOLD}) select question_id, route, case when route = 'narrative' then 0.5 when route in ('metadata', 'cross_modal') or (route = 'chart' and not {_R(Q.CHART)}) then 0.6 else 0.7 end confidence from r",
    "route_confusion": f"with r as (select case question_type {' '.join(f'''when '{a}' then '{b}' ''' for a, b in Q.ROUTE_OF.items())} end gold_route, {_ROUTE} route from {S.GOLD}) select gold_route, " + ", ".join(f"count_if(route = '{r}') {r}" for r in ("metadata", "chart", "cross_modal", "numeric", "narrative")) + " from r group by gold_route",
    "numeric_questions": f"select question_id, {S.company_code('company.code')} company_code, array_to_string({_YEARS}, ',') \"years\", array_to_string({_UNIQ}, ',') accounts, case when len({_UNIQ}) = 0 then null when {_R('佔|占|比率|比重|占比')} and len({_UNIQ}) >= 2 then 'ratio' when {_R('分別|(?:是多少.*){2,}')} then null when {_R('成長|增減|變動|年增|較.*(?:增加|減少)')} then case when {_R('比例|比率|率|幅度|百分比|成長|年增')} then 'growth' else 'delta' end else 'lookup' end kind from {S.GOLD}",
    "tolerance_defaults": f"select question_id, coalesce(tolerance.type, case when {S.canonical_unit('unit')} = '%' then 'absolute' else 'relative' end) \"type\", coalesce(tolerance.value, case when {S.canonical_unit('unit')} = '%' then 0.1 else 0.005 end) \"value\" from {S.GOLD}",
    "gold_problems": f"""with g as (select distinct question_id, unnest(list_distinct(list_filter([case when question_type is null or question_type not in ({', '.join(S.q(t) for t in V.TYPES)}) then 'unknown_type' end, case when length(trim(coalesce(question, ''), ' ')) = 0 then 'no_question' end, case when answerable and answer is null then 'answer_missing' end, case when not answerable and answer is not null then 'answer_of_unanswerable' end,
case when not answerable and coalesce(refusal_reason_class, '') not in ({', '.join(S.q(t) for t in V.REFUSALS)}) then 'refusal_class_missing' end, case when answerable and refusal_reason_class is not null then 'refusal_class_of_answerable' end, case when period is null or not regexp_matches(period, '{V.PERIOD}') then 'period' end, case when answerable and coalesce(len(source_document), 0) = 0 then 'no_source_document' end, case when answerable and coalesce(len(page_numbers), 0) = 0 then 'no_page' end,
case when len(list_filter(coalesce(page_numbers, []), lambda p: p < 1)) > 0 then 'page_below_one' end, case when len({_E.format("e.kind not in ('page', 'table_cell', 'chart_crop', 'sql_row')")}) > 0 then 'evidence_kind' end, case when len({_E.format("not regexp_matches(e.ref, '^[^#]+#p[0-9]+(/.*)?$')")}) > 0 then 'evidence_reference' end, case when tolerance.value <= 0 then 'tolerance' end, case when len(derived_from) = 1 then 'derived_from_one' end], lambda x: x is not null))) problem from gold) select * from g""",
    "repeated_ids": "select question_id, count(*) n from gold group by 1 having count(*) > 1",
    "repeated_questions": f"select question, count(*) n from {S.GOLD} group by 1 having count(*) > 1",
    "composition": f"select question_set, count(*) n, count_if(answerable) answerable, count_if(question_type = 'unanswerable') unanswerable, count_if(audited) audited, count(distinct company.code) codes, count_if(len(source_document) > 1) several_documents from {S.GOLD} group by 1",
    "filing_coverage": f"with c as (select distinct {S.filing_id('x')} doc_id from (select unnest(source_document) x from {S.GOLD})), a as (select doc_id from c where doc_id is not null), f as (select distinct doc_id from filing where doc_id is not null) select doc_id, 'missing' side from a anti join f using (doc_id) union all select doc_id, 'extra' from f anti join a using (doc_id)",
    "shared_companies": f"with g as (select {S.company_code('company.code')} code, question_set in ('dev', 'challenger') t from {S.GOLD}) select code, count_if(t) training, count_if(not t) evaluation from g where code is not null group by code having count_if(t) > 0 and count_if(not t) > 0",
    "manifest_counts": "select split, doc_type, count(*) filings, count_if(pages is null) without_pages, cast(sum(pages) as bigint) pages, min(fiscal_year) first_year, max(fiscal_year) last_year from filing group by all",
    "evidence_places": r"with g as (select question_id, any_value(required_evidence) r from gold group by 1), e as (select question_id, unnest(range(0, len(r))) i, unnest(r) e from g) select question_id, cast(i as integer) i, e.kind kind, regexp_extract(e.ref, '^([^#]+)#p([0-9]+)(?:/(.*))?$', 1) doc, try_cast(regexp_extract(e.ref, '^([^#]+)#p([0-9]+)', 2) as integer) page, regexp_extract(e.ref, '^([^#]+)#p([0-9]+)(?:/(.*))?$', 3) locator from e",
    "row_keys": "with g as (select question_id, any_value(structured_source_key).row_key k from gold group by 1), p as (select question_id, string_split(k, '|') p, len(string_split(k, '|')) = 4 and regexp_matches(string_split(k, '|')[2], '^p[0-9]+$') ok from g where k is not null) select question_id, case when ok then p[1] end doc, case when ok then p[3] end \"row\", case when ok then p[4] end \"column\", case when ok then cast(substring(p[2], 2) as integer) end page from p",
    "error_buckets": f"with b as (select unnest(list_filter([case when period is null then 'no_period' end, case when company.code is null then 'no_company' end, case when coalesce(len(source_document), 0) = 0 then 'no_source' end, case when answer is null then 'no_answer' end, case when not audited then 'not_audited' end], lambda x: x is not null)) bucket from {S.GOLD}) select bucket, count(*) n from b group by 1",
    "claim_support": f"with t as {_TARGETS}, c as (select doc_id doc, unnest(pages) page, text from {S.CHUNKS}), j as (select t.query, c.text, g.answer from t join c using (doc, page) join {S.GOLD} g on g.question_id = t.query where c.text is not null and g.answer is not null) select query, count(*) chunks, count_if(contains(text, answer)) verbatim, max(length({S.no_space('text')})) longest from j group by query",
    "variant_similarity": f"with g as (select distinct question_id, answer, v from (select question_id, any_value(answer) answer, unnest(any_value(acceptable_variants)) v from gold group by 1) where answer is not null), s as (select *, {S.gram_set('answer')} a, {S.gram_set('v')} b from g) select question_id, v variant, round(case when len(a) = 0 and len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) similarity, len(list_distinct(regexp_extract_all(answer, '([0-9][0-9,.]*[0-9][0-9,.%]*[0-9%]|[{S.CJK}]{{2,}})'))) atoms from s",
    "worklist": f"""with p as (select doc_id, pages[1] page, string_agg(coalesce(text, ''), chr(10) order by chunk_index, chunk_id) text from (select chunk_id, any_value(doc_id) doc_id, any_value(chunk_index) chunk_index, any_value(pages) pages, any_value(text) text from chunk where chunk_id is not null group by chunk_id) where len(pages) > 0 group by all),
f as (select doc_id, page, {S.no_white('text')} text from p), h as (select *, list_filter([{', '.join(f"case when contains(text, '{x}') then '{x}' end" for x in pages.HEADINGS)}], lambda x: x is not null) ph from f),
t as (select *, len(regexp_extract_all(text, '\\p{{Nd}}{{1,3}}(?:,\\p{{Nd}}{{3}})+')) figures, unnest([{', '.join("{'topic': '" + k + "', 'term': coalesce(" + ', '.join(f"case when contains(text, '{x}') then '{x}' end" for x in v) + ")}" for k, v in pages.PROBE_TOPICS.items())}]) x from h),
r as (select doc_id, x.topic topic, x.term term, page, figures, substring(text, greatest(position(x.term in text) - 40, 1), 120) excerpt, array_to_string(ph, '|') page_headings, cast(row_number() over (partition by doc_id, x.topic order by figures desc, page) as integer) rank from t where x.term is not null),
hp as (select doc_id, heading, list_sort(list_distinct(list(page)))[1:4] pages from (select doc_id, page, unnest(ph) heading from h) group by all), ha as (select doc_id, string_agg(heading || ':' || array_to_string(pages, ','), ';' order by heading) headings from hp group by 1)
select doc_id, topic, term, page, figures, excerpt, page_headings, coalesce(headings, '') headings, rank from r left join ha using (doc_id) where rank <= 2""",
}
