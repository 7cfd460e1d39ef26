"""Queries over pages and chunks: character defects, quality, runs, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.functions.text import furniture_key
from factlode.operators import chunking, pages as P
from factlode.plans import sqltext as S
from factlode.plans.retrieval import chunks
from factlode.runtime import load


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of each page: its distinct chunks in order (a chunk lies on its first page)."""
    c = chunks(spark, d).select("doc_id", F.element_at("pages", 1).alias("page"), F.struct("chunk_index", "chunk_id", F.coalesce("text", F.lit("")).alias("text")).alias("c")).where("size(pages) > 0")
    return c.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.text), "\n").alias("text"))


def page_defects(spark: SparkSession, d: str) -> DataFrame:
    return P.page_defects(page_texts(spark, d)).drop("text")


def defect_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return P.defect_verdicts(load(spark, d, "page_defect").distinct())


def document_defects(spark: SparkSession, d: str) -> DataFrame:
    return P.document_defects(P.defect_verdicts(load(spark, d, "page_defect").distinct()))


def silent_runs(spark: SparkSession, d: str) -> DataFrame:
    return P.silent_runs(page_texts(spark, d))


def page_quality(spark: SparkSession, d: str) -> DataFrame:
    return P.document_quality(page_texts(spark, d))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand on half the pages of a filing, digits aside."""
    lines = page_texts(spark, d).select("doc_id", "page", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "page", furniture_key(F.col("line")).alias("key"))
    return P.repeated_lines(lines)


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_windows(load(spark, d, "documents"), "doc_id", "text")


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The recorded chunks of each filing as blocks, gathered anew by section."""
    c = chunks(spark, d).select("doc_id", F.col("chunk_index").alias("ord"), F.element_at("pages", 1).alias("page"), F.element_at("kinds", 1).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "section_path").where("size(pages) > 0 and size(kinds) > 0")
    return chunking.section_chunks(c)


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_stats(chunks(spark, d), "parser")


QUERIES = {f.__name__: f for f in (page_defects, defect_verdicts, document_defects, silent_runs, page_quality, repeated_lines, fixed_chunks, section_chunks, chunk_stats)}

_PAGES = "(select doc_id, pages[1] page, string_agg(coalesce(text, ''), chr(10) order by chunk_index, chunk_id) text from (select chunk_id, any_value(doc_id) doc_id, any_value(chunk_index) chunk_index, any_value(pages) pages, any_value(text) text from chunk where chunk_id is not null group by chunk_id) where len(pages) > 0 group by all)"
_INK = S.no_white("coalesce(text, '')")
_RUNS = f"""(with p as {_PAGES}, s as (select distinct doc_id, page from p where length({_INK}) > 0 union all select doc_id, 0 from p group by doc_id union all select doc_id, max(page) + 1 from p group by doc_id), n as (select *, lead(page) over (partition by doc_id order by page) nx from s) select doc_id, page + 1 first, nx - 1 last from n where nx > page + 1)"""
_V = """(select *, characters >= 50 judged, (off_script + controls + private_use + other) bad, case when characters > 0 then (off_script + controls + private_use + other) / characters else 0 end r from (select distinct * from page_defect))"""
_ANY = lambda ts: "(" + " or ".join(f"contains(text, '{t}')" for t in ts) + ")"
_ODD = f"regexp_replace({_INK}, '[{P.CORE}]', '', 'g')"
SQL = {
    "page_defects": f"""with p as {_PAGES}, o as (select doc_id, page, length({_INK}) characters, {_ODD} odd from p), r as (select *, regexp_replace(odd, '[{P.CONTROL}{P.PRIVATE}]', '', 'g') rest from o)
select doc_id, page, characters, length(regexp_replace(rest, '[^{P.letters()}]', '', 'g')) off_script, length(regexp_replace(odd, '[^{P.CONTROL}]', '', 'g')) controls, length(regexp_replace(odd, '[^{P.PRIVATE}]', '', 'g')) private_use, length(rest) - length(regexp_replace(rest, '[^{P.letters()}]', '', 'g')) other from r""",
    "defect_verdicts": f"select doc_id, page, characters, off_script, controls, private_use, other, round(r, 6) rate, judged, coalesce(judged and r > 0.05, false) garbled, case when judged and r > 0.05 then list_max([{{'n': cast(off_script as bigint), 'k': 'off_script'}}, {{'n': cast(controls as bigint), 'k': 'control_characters'}}, {{'n': cast(private_use as bigint), 'k': 'private_use'}}, {{'n': cast(other as bigint), 'k': 'other'}}]).k else '' end mode from {_V}",
    "document_defects": f"select doc_id, count(*) pages, count_if(judged) judged_pages, count_if(judged and r > 0.05) garbled_pages, round(coalesce(count_if(judged and r > 0.05) / nullif(count_if(judged), 0), 0), 6) garbled_share, round(coalesce(sum(bad) / nullif(sum(characters), 0), 0), 6) rate, count_if(private_use > 0) unreadable_pages from {_V} group by doc_id",
    "silent_runs": f"select * from {_RUNS}",
    "page_quality": f"""with p as {_PAGES}, g as (select doc_id, max(page) pages, cast(sum(length(text)) as bigint) characters, count_if(length({_INK}) > 0) with_text, count_if(length({_INK}) > 0 and {_ANY(P.ANCHORS)}) readable, min(case when {_ANY(P.STATEMENTS)} then page end) first_statement_page from p group by doc_id),
l as (select doc_id, max(last - first + 1) longest_silence from {_RUNS} group by doc_id), j as (select g.*, coalesce(longest_silence, 0) longest_silence from g left join l using (doc_id))
select *, case when pages < 20 then 'too_short' when readable = 0 then 'unusable_text_layer' when readable / with_text < 0.6 then 'partially_unusable_text_layer' when longest_silence >= 5 then 'statements_not_machine_readable' when first_statement_page is null then 'missing_financial_statements' else 'usable' end verdict from j""",
    "repeated_lines": f"""with l as (select doc_id, page, regexp_replace(trim(regexp_replace(line, '[\\x{{9}}-\\x{{D}}\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'), ' '), '[0-9]+', '#', 'g') key from (select doc_id, page, unnest(string_split(text, chr(10))) line from {_PAGES})), n as (select doc_id, count(distinct page) pages from l group by 1),
k as (select doc_id, key, count(distinct page) on_pages from l where key <> '' group by all) select doc_id, key, on_pages from k join n using (doc_id) where on_pages >= greatest(2, floor(pages * 0.5))""",
    "fixed_chunks": f"""with d as (select doc_id, text, unnest(range(0, greatest(0, cast(ceil((length(text) - 800) / 700.0) as bigint) * 700) + 1, 700)) start from documents where length(text) > 0), w as (select doc_id, start, substring(text, start + 1, 800) text from d), i as (select * from w where length({S.no_white('text')}) > 0)
select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) chunk, cast(start as integer) "start", text from i""",
    "section_chunks": """with recursive b as (select doc_id, pages[1] page, kinds[1] kind, coalesce(text, '') text, coalesce(section_path, []) path, row_number() over (partition by doc_id order by chunk_index, chunk_id) i
from (select chunk_id, any_value(doc_id) doc_id, any_value(chunk_index) chunk_index, any_value(pages) pages, any_value(kinds) kinds, any_value(text) text, any_value(section_path) section_path from chunk where chunk_id is not null group by chunk_id) where len(pages) > 0 and len(kinds) > 0),
a as (select *, kind in ('table', 'figure', 'caption') atomic from b), s as (select *, i = 1 or atomic or lag(atomic) over w or path <> lag(path) over w st from a window w as (partition by doc_id order by i)),
r(doc_id, i, held, c) as (select doc_id, i, length(text), 1 from s where i = 1 union all select s.doc_id, s.i, case when s.st or r.held + length(s.text) > 1200 then length(s.text) else r.held + length(s.text) end, r.c + case when s.st or r.held + length(s.text) > 1200 then 1 else 0 end from r join s on s.doc_id = r.doc_id and s.i = r.i + 1),
g as (select doc_id, c, any_value(path) path, string_agg(text, chr(10) order by i) body, list(page order by i) pages, list(kind order by i) kinds, bool_or(atomic) atomic from s join r using (doc_id, i) group by doc_id, c),
m(doc_id, c, o, path, atomic) as (select doc_id, c, 1, path, atomic from g where c = 1 union all select doc_id, c, o + case when can then 0 else 1 end, case when not can or path = was then path else path[1 : len(path) - 1] end, not can and atomic from (select g.doc_id, g.c, m.o, g.path, m.path was, g.atomic, not g.atomic and not m.atomic
and case when len(g.path) > 0 then length(array_to_string(g.path, ' > ')) + 1 else 0 end + length(g.body) < 200 and (g.path = m.path or (len(g.path) = len(m.path) and len(g.path) >= 2 and g.path[1 : len(g.path) - 1] = m.path[1 : len(m.path) - 1])) can from m join g on g.doc_id = m.doc_id and g.c = m.c + 1)),
f as (select doc_id, o, arg_max(m.path, c) path, string_agg(body, chr(10) order by c) body, flatten(list(pages order by c)) pages, flatten(list(kinds order by c)) kinds from m join g using (doc_id, c) group by doc_id, o)
select doc_id, cast(o - 1 as integer) chunk, case when len(path) > 0 then array_to_string(path, ' > ') || chr(10) else '' end || body text, path section_path, list_sort(list_distinct(pages)) pages, list_filter(kinds, lambda x, i: list_position(kinds, x) = i) kinds from f""",
    "chunk_stats": f"select parser, count(*) n, round(avg(length(text)), 6) mean_chars, max(length(text)) max_chars, count_if(len(section_path) > 0) with_section, count_if(len(pages) > 1) cross_page from {S.CHUNKS} group by parser",
}
