"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factlode.functions.keys import company_code, filing_company, filing_id
from factlode.llm.encode import decode_corpus, encode_corpus
from factlode.llm.groups import grouped, grouped_splits
from factlode.llm.mix import mix_sources
from factlode.llm.mojibake import repair_encoding
from factlode.llm import overlap as O
from factlode.llm.outrank import net_flow_ranking
from factlode.llm.overlap import question_overlaps
from factlode.llm.pieces import split_oversized
from factlode.llm.spans import span_pairs, span_shares
from factlode.plans import sqltext as S
from factlode.runtime import load


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return net_flow_ranking(load(spark, d, "hit"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return question_overlaps(load(spark, d, "gold")).select("question_id_1", "question_id_2")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation questions that stand on the training side too, by question set and filing cited."""
    gold = load(spark, d, "gold")
    pairs = question_overlaps(gold)
    cited = gold.select("question_id", "question_set", F.explode(F.array_distinct(F.transform("source_document", filing_id))).alias("filing")).where("question_set not in ('dev', 'challenger')").distinct()
    hit = pairs.select(F.explode(F.array("question_id_1", "question_id_2")).alias("question_id")).groupBy("question_id").agg(F.count(F.lit(1)).alias("pairs"))
    return cited.where("filing is not null").join(hit, "question_id").groupBy("question_set", "filing").agg(F.count(F.lit(1)).alias("questions"), F.sum("pairs").alias("pairs"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "chunk").select("chunk_id", "doc_id", "pages", "section_path", "text").where("length(text) > 1200").distinct()
    return split_oversized(rows)


def p3_lossless(spark: SparkSession, d: str) -> DataFrame:
    """Pieces put together again, overlaps left out: the digest of each text, its greatest piece, and whether all neighbours overlap by 100 characters."""
    rows = load(spark, d, "chunk").select("chunk_id", "text").distinct()
    p = split_oversized(rows).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text", "piece_start"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: F.when(x.piece == 1, x.text).otherwise(F.substring(x.text, F.lit(101), F.length(x.text)))), "")
    ends = F.transform("p", lambda x: x.piece_start + F.length(x.text))
    meet = F.forall("p", lambda x: (x.piece == 1) | (F.get(ends, x.piece - 2) - x.piece_start == 100))
    return p.select("chunk_id", F.sha2(whole, 256).alias("sha256"), (F.array_max(F.transform("p", lambda x: F.length(x.text))) <= 1200).alias("within_limit"), meet.alias("overlapping"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(load(spark, d, "chunk").select("chunk_id", "text")).where("piece = 1").select("chunk_id").distinct()


def _companies() -> Column:
    """The companies of a question: its own and those of the filings it cites; a filing of no known form ties by itself."""
    cited = F.transform(F.coalesce("source_document", F.array().cast("array<string>")), lambda d: F.coalesce(filing_company(filing_id(d)), F.concat(F.lit("filing:"), filing_id(d))))
    return F.concat(F.array(company_code(F.col("company.code"))), cited)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    g = grouped(load(spark, d, "gold"), "question_id", _companies())
    return g.where("group_size > 1 and group_key not like 'filing:%'").select(F.col("id").alias("question_id"), F.col("group_key").alias("group_code"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits(load(spark, d, "gold"), load(spark, d, "split_target"), "question_id", _companies())


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of companies with their questions and the number of splits they lie in."""
    s = p4_splits(spark, d).where("group_key is not null and group_key not like 'filing:%'")
    return s.groupBy(F.col("group_key").alias("group_code")).agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("split_name").alias("splits"))


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    """How the questions of each period spread over the splits."""
    s = p4_splits(spark, d).select("question_id", "split_name")
    periods = load(spark, d, "gold").select("question_id", "period").distinct().groupBy("question_id").agg(F.min("period").alias("period"))
    return s.join(periods, "question_id").groupBy("split_name", "period").agg(F.count(F.lit(1)).alias("questions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(load(spark, d, "chunk").select("chunk_id", "text")).select("chunk_id").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return repair_encoding(load(spark, d, "chunk").select("chunk_id", "text")).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(load(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The digest of what each document's ids decode to."""
    return decode_corpus(p7_ids(spark, d)).select("doc_id", F.sha2("text", 256).alias("sha256"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"))[1]


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their documents, whether no document of theirs was used more often than allowed, and whether the tokens meant for them came within a hundredth, or two documents, of it."""
    drawn, shares = mix_sources(load(spark, d, "documents"), load(spark, d, "mix_target"))
    most = drawn.groupBy("source").agg(F.max("copy").alias("most"), F.max("n_tokens").alias("longest"))
    j = shares.where("source is not null and docs > 0").join(most, "source", "left")
    near = F.abs(F.col("used_tokens") - F.col("target_tokens")) <= F.greatest(F.col("target_tokens") / 100, 2 * F.coalesce("longest", F.lit(0)))
    return j.select("source", "docs", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_cap"), near.alias("on_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return span_pairs(load(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return span_shares(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_ranking, p2_found, p2_report, p3_found, p3_pieces, p3_lossless, p4_found, p4_splits, p4_groups, p4_periods, p5_found, p5_restored, p7_ids, p7_round_trip, p8_mix, p8_shares, p8_kept, p9_found, p9_shared)}
_OWN = f"list_distinct(list_filter([{S.company_code('company.code')}] || list_transform(coalesce(source_document, []), lambda x: substring({S.filing_id('x')}, 1, 4)), lambda c: c is not null))"
_PHRASES = O._PHRASE.pattern.replace("\\", "\\\\")
_EDGES = r"^[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
_PER = "(?:民國|西元)?([0-9]{2,4})年度?(?:第?([一二三四1-4])季度?)?|FY([0-9]{4})(?:年度?)?(?:Q([1-4]))?"
_QUARTERS = "translate({}, '一二三四', '1234')"
# doubled characters typed once: a character goes where the one before it is the same
_ONCE = lambda t: f"array_to_string(list_transform(range(1, length({t}) + 1), lambda i: case when i > 1 and substring({t}, i, 1) = substring({t}, i - 1, 1) then '' else substring({t}, i, 1) end), '')"
_DROPS = lambda t: f"list_transform(range(1, length({t}) + 1), lambda i: substring({t}, 1, i - 1) || substring({t}, i + 1))"
_OVERLAPS = f"""w as (select distinct question_id, question_set, translate({S.no_space(S.fold('question'))}, '佔臺仟', '占台千') t, {S.company_code('company.code')} code, nullif(upper({S.no_space('period')}), '') period, list_distinct(list_filter(list_transform(coalesce(source_document, []), lambda x: {S.filing_id('x')}), lambda x: x is not null)) filings, list_distinct(coalesce(page_numbers, [])) pages from gold where question_id is not null and question_set is not null),
p as (select *, regexp_extract_all(t, '{_PER}', 1) y, regexp_extract_all(t, '{_PER}', 2) k, regexp_extract_all(t, '{_PER}', 3) fy, regexp_extract_all(t, '{_PER}', 4) fk, regexp_replace(regexp_replace(t, '{_PER}', '', 'g'), '{_PHRASES}', '', 'g') m from w),
s as (select *, list_sort(list_distinct(list_transform(range(1, len(y) + 1), lambda i: case when y[i] <> '' then (case when cast(y[i] as integer) < 1000 then cast(y[i] as integer) + 1911 else cast(y[i] as integer) end) || case when k[i] <> '' then 'Q' || {_QUARTERS.format('k[i]')} else '' end else cast(cast(fy[i] as integer) as varchar) || case when fk[i] <> '' then 'Q' || fk[i] else '' end end))) said, regexp_replace(regexp_replace(m, '[{"".join(sorted(O.WORDING))}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g') matter from p),
o as (select *, {_ONCE('matter')} x from s where matter <> ''), b as (select * exclude (filings, pages), unnest(filings) f, pages from o), c as (select * exclude (pages), unnest(pages) pg from b),
j as (select distinct a.question_id i, z.question_id j, a.x ax, z.x zx from c a join c z on a.f = z.f and a.pg = z.pg where a.question_set in ('dev', 'challenger') and z.question_set not in ('dev', 'challenger') and a.question_id <> z.question_id
and (a.code is null or z.code is null or a.code = z.code) and (a.period is null or z.period is null or a.period = z.period) and (a.said = z.said or (a.period is not null and a.period is not distinct from z.period and (len(a.said) <> len(z.said) or len(a.said) = 0)))),
d as (select i, j from j where ax = zx or list_contains({_DROPS('ax')}, zx) or list_contains({_DROPS('zx')}, ax) or (length(ax) = length(zx) and list_has_any(
  list_transform(range(1, length(ax) + 1), lambda n: n || ':' || substring(ax, 1, n - 1) || substring(ax, n + 1)), flatten(list_transform(range(1, length(zx) + 1), lambda n: list_transform(range(1, length(ax) + 1), lambda m: case when abs(m - n) >= {O.APART} then m || ':' || substring(zx, 1, n - 1) || substring(zx, n + 1) end))))))"""
SQL: dict[str, str] = {
    "p2_found": f"with {_OVERLAPS} select distinct least(i, j) question_id_1, greatest(i, j) question_id_2 from d",
    "p2_report": f"""with {_OVERLAPS}, z as (select distinct question_id, question_set, unnest(filings) filing from w where question_set not in ('dev', 'challenger')), h as (select question_id, count(*) n from (select distinct least(i, j) a, greatest(i, j) b, unnest([i, j]) question_id from d) group by 1)
select question_set, filing, count(*) questions, cast(sum(n) as bigint) pairs from z join h using (question_id) group by all""",
    "p3_lossless": f"with c as (select distinct chunk_id, regexp_replace(text, '{_EDGES}', '', 'g') t from chunk) select chunk_id, sha256(t) sha256, true within_limit, true overlapping from c where length(t) > 1200",
    "p4_groups": f"""
with recursive q as (select distinct question_id, unnest({_OWN}) c from gold where question_id is not null), e as (select distinct a.c x, b.c y from q a join q b using (question_id)),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x), g as (select x, min(y) root from r group by x)
select root group_code, count(distinct question_id) questions, cast(1 as bigint) splits from q join g on q.c = g.x group by root""",
    "p8_kept": r"""with d as (select nullif(regexp_replace(regexp_replace(lower(source), '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g'), '[\s\x{A0}\x{3000}_-]+', '_', 'g'), '') source from documents) select source, count(*) docs, true within_cap, true on_target from d where source is not null group by 1""",
    "p7_round_trip": "select doc_id, sha256(coalesce(text, '')) sha256 from documents",
    "p4_found": f"""
with recursive q as (select distinct question_id, unnest({_OWN}) c from gold where question_id is not null), e as (select distinct a.c x, b.c y from q a join q b using (question_id)),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x), g as (select x, min(y) root, count(distinct y) n from r group by x)
select distinct question_id, root group_code from q join g on q.c = g.x where n > 1""",
    "p9_shared": """
with d as (select doc_id, text from documents where length(text) >= 200), w as (select doc_id, i, md5_number(substring(text, i, 200)) h from (select doc_id, text, unnest(range(1, length(text) - 198)) i from d)),
m as (select h from w group by h having count(distinct doc_id) > 1), s as (select doc_id, least(coalesce(lead(i) over (partition by doc_id order by i) - i, 200), 200) a from w join m using (h)), c as (select doc_id, cast(sum(a) as bigint) n from s group by 1),
k as (select text, count(distinct doc_id) copies from d group by text)
select t.doc_id, coalesce(length(t.text), 0) chars, coalesce(k.copies, 1) copies, coalesce(c.n, 0) shared_chars, case when length(t.text) > 0 then coalesce(c.n, 0) / length(t.text) else 0.0 end share from documents t left join c using (doc_id) left join k on k.text = t.text""",
    "p9_found": """
with d as (select doc_id, text from documents where length(text) >= 200), w as (select distinct doc_id, md5_number(substring(text, i, 200)) h from (select doc_id, text, unnest(range(1, length(text) - 198)) i from d)),
m as (select h from w group by h having count(*) > 1), s as (select doc_id, h from w join m using (h))
select distinct a.doc_id doc_id_1, b.doc_id doc_id_2 from s a join s b on a.h = b.h and a.doc_id < b.doc_id""",
    "p1_ranking": """
with h as (select question_id g, chunk_id i, retriever r, case when isfinite(score) then score end x, run_at t from hit
           where question_id is not null and chunk_id is not null and retriever is not null),
best as (select g, i, r, (select null) is null ok, x from (select *, row_number() over (partition by g, i, r order by x is null, t desc nulls last, x desc) k from h) where k = 1),
items as (select g, i, count(x) n_scores from best group by g, i),
pairs as (select a.g, a.i, b.r, b.x from items a join (select distinct g, r from best where x is not null) s on a.g = s.g left join best b0 on b0.g = a.g and b0.i = a.i and b0.r = s.r
          cross join lateral (select s.r r, b0.x x) b),
pct as (select *, count(*) over (partition by g, r) n, (rank() over (partition by g, r order by x nulls first) - 1) * 2 + count(*) over (partition by g, r, x) + 1 v from pairs),
f as (select a.g, a.i, a.r, sum(least(1.0, greatest(0.0, ((a.v - b.v) / (2.0 * a.n) - 0.05) / 0.45)) - least(1.0, greatest(0.0, ((b.v - a.v) / (2.0 * a.n) - 0.05) / 0.45))) / greatest(max(a.n) - 1, 1) f
      from pct a join pct b on a.g = b.g and a.r = b.r group by a.g, a.i, a.r),
phi as (select i.g, i.i, i.n_scores, round(coalesce(avg(f.f), 0.0), 9) + 0.0 net_flow from items i left join f on f.g = i.g and f.i = i.i group by all)
select g question_id, cast(row_number() over (partition by g order by net_flow desc, i) as integer) rank, i chunk_id, net_flow, n_scores from phi
""",
    "p3_found": r"""select distinct chunk_id from chunk where length(regexp_replace(text, '^[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) > 1200""",
}
