"""Quality of a text layer: characters that do not belong, unreadable pages and silent runs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.functions.text import excerpt

#: What a sound filing is made of, as ranges and single characters.
CORE = r"\x{20}-\x{7E}\x{2000}-\x{22FF}\x{2460}-\x{24FF}\x{25A0}-\x{27BF}\x{3000}-\x{303F}\x{3100}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}®é×§öó°÷íÖ±Δäø¥€µ‰Ω©²³½àáâãçèêëìîïñòôõùúûüýÿÁÉÍÓÚÜÑÇ"
WHITE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x{0}-\x{1F}\x{7F}-\x{9F}"
PRIVATE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}"
#: A page is judged from so many characters on, and garbled beyond this rate.
MIN_CHARACTERS, GARBLED = 50, 0.05
#: Words of which a readable page holds one, and names of the statements.
ANCHORS = ["公司", "年度", "財務", "營業", "股東", "董事", "合併", "資產", "負債", "附註", "單位"]
STATEMENTS = ["合併資產負債表", "合併綜合損益表", "會計師查核報告"]
MIN_PAGES, MIN_READABLE, MIN_SILENT = 20, 0.6, 5


@lru_cache(1)
def letters() -> str:
    """A character class of all letters and marks beyond ASCII, of one version of Unicode in every engine."""
    runs: list[list[int]] = []
    for i in range(0x80, 0x110000):
        if not 0x4E00 <= i <= 0x9FFF and unicodedata.category(chr(i))[0] in "LM":
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def _kept(c: Column, cls: str) -> Column:
    return F.regexp_replace(c, f"[^{cls}]", "")


def page_defects(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """``pages`` with its character counts: characters (without white space), controls, private_use, off_script, other."""
    inked = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{WHITE}]", "")
    odd = F.regexp_replace(F.col("__inked"), f"[{CORE}]", "")
    rest = F.regexp_replace(F.col("__odd"), f"[{CONTROL}{PRIVATE}]", "")
    d = pages.withColumn("__inked", inked).withColumn("__odd", odd).withColumn("__rest", rest)
    foreign = F.length(_kept(F.col("__rest"), letters()))
    d = d.select(*pages.columns, F.length("__inked").alias("characters"), foreign.alias("off_script"), F.length(_kept(F.col("__odd"), CONTROL)).alias("controls"), F.length(_kept(F.col("__odd"), PRIVATE)).alias("private_use"), (F.length("__rest") - foreign).alias("other"))
    return d


def defect_verdicts(counts: DataFrame) -> DataFrame:
    """Page counts with rate, judged, garbled and mode (the greatest kind; ties go to the later name)."""
    total = F.col("off_script") + F.col("controls") + F.col("private_use") + F.col("other")
    rate = F.when(F.col("characters") > 0, total / F.col("characters")).otherwise(F.lit(0.0))
    judged = F.col("characters") >= MIN_CHARACTERS
    garbled = judged & (rate > GARBLED)
    kinds = F.array(*[F.struct(F.col(c).cast("long").alias("n"), F.lit(name).alias("name")) for c, name in (("off_script", "off_script"), ("controls", "control_characters"), ("private_use", "private_use"), ("other", "other"))])
    return counts.select("*", F.round(rate, 6).alias("rate"), judged.alias("judged"), garbled.alias("garbled"), F.when(garbled, F.array_max(kinds)["name"]).otherwise("").alias("mode"))


def document_defects(verdicts: DataFrame) -> DataFrame:
    """Per document: judged and garbled pages, the garbled share of judged pages, off-core rate and pages with unreadable characters."""
    total = F.sum(F.col("off_script") + F.col("controls") + F.col("private_use") + F.col("other"))
    return verdicts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("judged").alias("judged_pages"), F.count_if("garbled").alias("garbled_pages"),
        F.round(F.coalesce(F.try_divide(F.count_if("garbled"), F.count_if("judged")), F.lit(0.0)), 6).alias("garbled_share"), F.round(F.coalesce(F.try_divide(total, F.sum("characters")), F.lit(0.0)), 6).alias("rate"), F.count_if(F.col("private_use") > 0).alias("unreadable_pages"),
    )


def silent_runs(pages: DataFrame) -> DataFrame:
    """Runs of pages (doc_id, page, text) without text, between page 1 and the last known: doc_id, first, last."""
    seen = pages.where(F.length(F.trim(F.regexp_replace("text", f"[{WHITE}]", ""))) > 0).select("doc_id", "page").distinct()
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("n"))
    edges = seen.unionAll(ends.select("doc_id", F.lit(0).alias("page"))).unionAll(ends.select("doc_id", (F.col("n") + 1).alias("page")))
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))
    return edges.withColumn("next", nxt).where(F.col("next") > F.col("page") + 1).select("doc_id", (F.col("page") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def document_quality(pages: DataFrame, anchors: list[str] = ANCHORS, statements: list[str] = STATEMENTS) -> DataFrame:
    """Whether a document can be used: counts and the first verdict that applies.

    pages: doc_id, page, text; pages missing below the last are silent.
    """
    some = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("text"), t))
    inked = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{WHITE}]", "")) > 0
    p = pages.groupBy("doc_id").agg(
        F.max("page").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.count_if(inked).alias("with_text"), F.count_if(inked & some(anchors)).alias("readable"), F.min(F.when(some(statements), F.col("page"))).alias("first_statement_page"),
    )
    runs = silent_runs(pages).groupBy("doc_id").agg(F.max(F.col("last") - F.col("first") + 1).alias("longest_silence"))
    j = p.join(runs, "doc_id", "left").withColumn("longest_silence", F.coalesce("longest_silence", F.lit(0)))
    verdict = (
        F.when(F.col("pages") < MIN_PAGES, "too_short").when(F.col("readable") == 0, "unusable_text_layer").when(F.col("readable") / F.col("with_text") < MIN_READABLE, "partially_unusable_text_layer")
        .when(F.col("longest_silence") >= MIN_SILENT, "statements_not_machine_readable").when(F.col("first_statement_page").isNull(), "missing_financial_statements").otherwise("usable")
    )
    return j.withColumn("verdict", verdict)


def repeated_lines(lines: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """Lines (doc_id, page, key) that stand on at least max(``least``, ``share`` of the pages): running heads and feet."""
    n = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    k = lines.where("key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on_pages"))
    return k.join(n, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("doc_id", "key", "on_pages")


def page_offsets(pages: DataFrame) -> DataFrame:
    """Where each page lies in the text of its document, joined by line ends: doc_id, page, start, end (behind the last character); empty pages take no place."""
    p = pages.where(F.length("text") > 0).select("doc_id", "page", F.length("text").alias("n"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.select("doc_id", "page", start.alias("start"), (start + F.col("n")).alias("end"))


#: Topics of probes and the spellings that locate each on a page, the first before the next.
PROBE_TOPICS = {"revenue": ["營業收入"], "gross_profit": ["營業毛利"], "operating_income": ["營業利益"], "net_income": ["本期淨利", "淨利（淨損）"], "eps": ["基本每股盈餘", "每股盈餘"], "total_assets": ["資產總額", "資產總計"]}
#: Headings that mark a statement.
HEADINGS = ["合併綜合損益表", "合併損益表", "綜合損益表", "資產負債表", "合併資產負債表"]


def worklist(pages: DataFrame, topics: dict[str, list[str]] = PROBE_TOPICS, top_k: int = 2, pages_of_heading: int = 4) -> DataFrame:
    """The pages of a document to open for each topic, richest in figures first; ties go by page number.

    pages: doc_id, page, text.  Gives doc_id, topic, term (the first of the topic's that stands on the page), page, figures, excerpt,
    page_headings (statement headings on that page), headings (each heading of the document with its first pages) and rank.
    Blanks are left out of the text before anything is looked for; headings orient and filter nothing.
    """
    flat = pages.select("doc_id", "page", F.regexp_replace("text", f"[{WHITE}]+", "").alias("text"))
    flat = flat.withColumn("page_headings", F.array_compact(F.array(*[F.when(F.contains("text", F.lit(h)), h) for h in HEADINGS])))
    first = lambda terms: F.coalesce(*[F.when(F.contains("text", F.lit(t)), t) for t in terms])
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("topic"), first(t).alias("term")) for k, t in topics.items()]), lambda x: x.term.isNotNull())
    hits = flat.select("doc_id", "page", "page_headings", "text", F.regexp_count("text", F.lit(r"(?U)\d{1,3}(?:,\d{3})+")).alias("figures"), F.explode(found).alias("t"))
    hits = hits.select("doc_id", "t.topic", "t.term", "page", "figures", excerpt(F.col("text"), F.col("t.term")).alias("excerpt"), "page_headings")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy(F.desc("figures"), "page"))).where(F.col("rank") <= top_k)
    at = flat.select("doc_id", "page", F.explode("page_headings").alias("heading")).groupBy("doc_id", "heading").agg(F.slice(F.array_sort(F.collect_set("page")), 1, pages_of_heading).alias("pages"))
    at = at.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("heading", "pages"))).alias("headings"))
    empty = F.array().cast("array<struct<heading:string,pages:array<int>>>")
    return hits.join(at, "doc_id", "left").select("doc_id", "topic", "term", "page", "figures", "excerpt", "page_headings", F.coalesce("headings", empty).alias("headings"), "rank")
