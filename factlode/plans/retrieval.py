"""Retrieval over chunks: lexical, dense, fused, scoped, and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factlode.functions.keys import company_code, filing_id
from factlode.functions.text import characters_of
from factlode.operators import dense, fusion, lexical
from factlode.operators.similarity import similar_texts
from factlode.plans import sqltext as S
from factlode.runtime import load


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each (repeated rows are equal)."""
    return load(spark, d, "chunk").where("chunk_id is not null").dropDuplicates(["chunk_id"])


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Questions once each."""
    return load(spark, d, "gold").where("question_id is not null").dropDuplicates(["question_id"])


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_stats(lexical.postings(load(spark, d, "chunk"), "chunk_id", "text"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_search(load(spark, d, "chunk"), gold(spark, d), "chunk_id", "text", "question_id", "question", 20)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return dense.dense_search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(load(spark, d, "hit"), "question_id", "chunk_id", "retriever", "rank")


def scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hits are kept to the question's company before fusion and rank; a question that names none is not scoped."""
    h = load(spark, d, "hit")
    scope = gold(spark, d).select("question_id", company_code(F.col("company.code")).alias("code"))
    kept = h.join(scope, "question_id", "left").where("code is null or substring(doc_id, 1, 4) = code")
    return fusion.fuse(kept, "question_id", "chunk_id", "retriever", "rank", top_k=20)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).select(F.col("question_id").alias("query"), F.explode(F.transform("source_document", filing_id)).alias("doc"), "page_numbers")
    return g.select("query", "doc", F.explode("page_numbers").alias("page")).where("doc is not null and page is not null").distinct()


def _hits(spark: SparkSession, d: str, retriever: str) -> DataFrame:
    h = load(spark, d, "hit").where(F.col("retriever") == retriever)
    return h.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"), F.first("doc_id").alias("doc"), F.first("pages").alias("pages")).withColumnRenamed("question_id", "query")


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    return fusion.retrieval_metrics(_hits(spark, d, "rerank"), _targets(spark, d))


def budget_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether reading 8,000 characters of the lexical ranking meets a target."""
    h = _hits(spark, d, "lexical").join(chunks(spark, d).select("chunk_id", characters_of(F.coalesce("text", F.lit(""))).alias("chars")), "chunk_id")
    read = fusion.within_budget(h, 8000)
    met = fusion.evidence_hits(read, _targets(spark, d)).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    per = read.groupBy("query").agg(F.count(F.lit(1)).alias("chunks_read"), F.sum("chars").alias("chars_read"))
    return per.join(met, "query", "left").select("query", "chunks_read", "chars_read", F.col("n").isNotNull().alias("met"))


def neardup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_texts(gold(spark, d), "question_id", "question", 0.8)[0]


def neardup_members(spark: SparkSession, d: str) -> DataFrame:
    return similar_texts(gold(spark, d), "question_id", "question", 0.8)[1]


def answer_chunk_rank(spark: SparkSession, d: str) -> DataFrame:
    """The best rank of a chunk that holds the recorded answer, by retriever."""
    h = load(spark, d, "hit").groupBy("question_id", "retriever", "chunk_id").agg(F.min("rank").alias("rank"))
    a = gold(spark, d).select("question_id", "answer").where("length(answer) >= 3")
    j = h.join(a, "question_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return j.where(F.contains("text", F.col("answer"))).groupBy("question_id", "retriever").agg(F.min("rank").alias("best_rank"))


def retriever_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement: for each question the chunks that lexical and dense share, and how far apart they rank them."""
    h = load(spark, d, "hit").groupBy("question_id", "chunk_id").pivot("retriever", ["lexical", "dense"]).agg(F.min("rank"))
    return h.where("lexical is not null and dense is not null").groupBy("question_id").agg(F.count(F.lit(1)).alias("shared"), F.max(F.abs(F.col("lexical") - F.col("dense"))).alias("widest"))


def page_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose section differs from the chunk before in the same filing (a lag over its order)."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    c = chunks(spark, d).withColumn("section", F.array_join("section_path", " > ")).withColumn("before", F.lag("section").over(w)).withColumn("first", F.row_number().over(w) == 1)
    return c.where("not first and not (section <=> before)").select("doc_id", "chunk_id", "section", "before")


QUERIES = {f.__name__: f for f in (term_stats, bm25_topk, dense_topk, rrf_hybrid, scoped_topk, recall_mrr, budget_recall, neardup_pairs, neardup_members, answer_chunk_rank, retriever_pairs, page_neighbours)}

_TARGETS = f"(select distinct question_id query, doc, unnest(page_numbers) page from (select question_id, page_numbers, unnest(list_transform(source_document, lambda x: {S.filing_id('x')})) doc from {S.GOLD}) where doc is not null)"
_HITS = lambda r: f"(select question_id query, chunk_id, min(rank) rank, any_value(doc_id) doc, any_value(pages) pages from hit where retriever = '{r}' group by all)"
_NEAR = f"""with g as (select question_id id, list_sort({S.gram_set('question')}) grams from {S.GOLD} where question is not null), r as (select *, list_aggregate(grams, 'string_agg', chr(1)) k from g where len(grams) > 0),
m as (select id, min(id) over (partition by k) class from r), s as (select distinct m.class, r.grams from m join r on m.class = r.id) """
SQL = {
    "term_stats": f"with t as (select chunk_id, unnest({S.tokens('text')}) term from {S.CHUNKS}), p as (select term, chunk_id, count(*) tf from t group by all) select term, count(*) df, cast(sum(tf) as bigint) cf from p group by term",
    "bm25_topk": f"""with d as (select chunk_id doc, {S.tokens('text')} terms from {S.CHUNKS}), n as (select count(*) n_docs, avg(len(terms)) avg_len from d),
p as (select doc, len(terms) len, unnest(terms) term from d), tf as (select doc, term, any_value(len) len, count(*) tf from p group by all), df as (select term, count(*) df from tf group by term),
q as (select question_id query, unnest({S.tokens('question')}) term from {S.GOLD}), qt as (select query, term, count(*) qtf from q group by all),
s as (select query, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) score from tf join df using (term) join qt using (term), n group by query, doc),
r as (select *, cast(row_number() over (partition by query order by score desc, doc) as integer) rank from s) select query, doc, score, rank from r where rank <= 20""",
    "dense_topk": """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), u as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from e),
s as (select a.vec_id query, b.vec_id doc, round(list_inner_product(a.v, b.v) / (a.n * b.n), 6) + 0.0 score from u a join u b on a.vec_id % 50 = 0), r as (select *, cast(row_number() over (partition by query order by score desc, doc) as integer) rank from s) select query, doc, score, rank from r where rank <= 20""",
    "rrf_hybrid": """with f as (select question_id query, retriever, chunk_id item, min(rank) pos from hit group by all), p as (select *, row_number() over (partition by query, retriever order by pos, item) place from f),
s as (select query, item, round(sum(1.0 / (60 + place)), 9) score, cast(count(*) as integer) sources from p group by all) select *, cast(row_number() over (partition by query order by score desc, item) as integer) rank from s""",
    "scoped_topk": f"""with g as (select question_id, {S.company_code('company.code')} code from {S.GOLD}), h as (select h.* from hit h left join g using (question_id) where code is null or substring(doc_id, 1, 4) = code),
f as (select question_id query, retriever, chunk_id item, min(rank) pos from h group by all), p as (select *, row_number() over (partition by query, retriever order by pos, item) place from f),
s as (select query, item, round(sum(1.0 / (60 + place)), 9) score, cast(count(*) as integer) sources from p group by all), r as (select *, cast(row_number() over (partition by query order by score desc, item) as integer) rank from s) select * from r where rank <= 20""",
    "recall_mrr": f"""with t as {_TARGETS}, h as (select query, rank, doc, unnest(pages) page from {_HITS('rerank')}), m as (select distinct query, rank, doc, page from h join t using (query, doc, page)),
p as (select query, min(rank) first, count(distinct case when rank <= 5 then (doc, page) end) covered from m group by query), w as (select query, count(*) wanted, count(distinct page) pages from t group by query)
select query, coalesce(first, 1073741824) <= 5 recall, case when first <= 10 then round(1.0 / first, 9) else 0.0 end reciprocal_rank, coalesce(covered, 0) covered, wanted, coalesce(covered, 0) = wanted complete, case when pages >= 2 then coalesce(covered, 0) = wanted end crosses_pages from w left join p using (query)""",
    "budget_recall": f"""with t as {_TARGETS}, c as (select chunk_id, length({S.no_space("coalesce(text, '')")}) chars from {S.CHUNKS}), h as (select * from {_HITS('lexical')} join c using (chunk_id)),
s as (select *, coalesce(sum(chars) over (partition by query order by rank rows between unbounded preceding and 1 preceding), 0) spent from h), r as (select * from s where spent < 8000),
m as (select distinct r.query from (select query, doc, unnest(pages) page from r) r join t using (query, doc, page)) select r.query, count(*) chunks_read, cast(sum(chars) as bigint) chars_read, bool_or(m.query is not null) met from r left join m on m.query = r.query group by r.query""",
    "neardup_pairs": _NEAR + "select a.class class_1, b.class class_2, round(len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))), 3) similarity from s a join s b on a.class < b.class where len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams) - len(list_intersect(a.grams, b.grams))) >= 0.8",
    "neardup_members": _NEAR + "select id, class from m",
    "answer_chunk_rank": f"with h as (select question_id, retriever, chunk_id, min(rank) rank from hit group by all) select question_id, retriever, min(rank) best_rank from h join (select question_id, answer from {S.GOLD} where length(answer) >= 3) using (question_id) join {S.CHUNKS} c using (chunk_id) where contains(c.text, answer) group by all",
    "retriever_pairs": "with h as (select question_id, chunk_id, min(case when retriever = 'lexical' then rank end) l, min(case when retriever = 'dense' then rank end) e from hit group by all) select question_id, count(*) shared, max(abs(l - e)) widest from h where l is not null and e is not null group by question_id",
    "page_neighbours": "with c as (select chunk_id, any_value(doc_id) doc_id, any_value(chunk_index) i, any_value(section_path) p from chunk where chunk_id is not null group by chunk_id), s as (select *, array_to_string(p, ' > ') section from c), w as (select *, lag(section) over (partition by doc_id order by i, chunk_id) before, row_number() over (partition by doc_id order by i, chunk_id) k from s) select doc_id, chunk_id, section, before from w where k > 1 and section is distinct from before",
}
