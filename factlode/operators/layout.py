"""Typography of lines: body size, furniture, headings and the section each block stands in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.functions.text import furniture_key, numbering_level

#: Thresholds of size, length, margins and gaps.
RATIO, MAX_HEADING, EDGE, REPEAT, GAP, MAX_LEVEL = 1.15, 80, 0.07, 0.5, 1.8, 6
BODY_SHARE, BODY_CHARS = 0.03, 2000


def body_sizes(lines: DataFrame) -> DataFrame:
    """Per document the size of most characters, and the largest size that is still body text (at least 3 % and 2,000 characters)."""
    s = lines.withColumn("chars", F.length(F.regexp_replace("text", r"(?U)\s+", ""))).groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum("chars").alias("chars"))
    w = Window.partitionBy("doc_id")
    s = s.withColumn("all", F.sum("chars").over(w))
    body = (F.col("chars") >= BODY_SHARE * F.col("all")) & (F.col("chars") >= BODY_CHARS)
    return s.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("dominant"), F.max(F.when(body, F.col("size"))).alias("ceiling")).withColumn("ceiling", F.coalesce("ceiling", "dominant"))


def heading_shape(text: Column) -> Column:
    """Whether a text may be a heading: short, without the end of a sentence, with one figure at most."""
    t = F.trim(text)
    return (F.length(t) > 0) & (F.length(t) <= MAX_HEADING) & ~t.rlike("[。；！？]$") & (F.regexp_count(F.regexp_replace(t, r"^[0-9.]+", ""), F.lit(r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+\.[0-9]+")) <= 1)


def classify(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, i, text, x0, y0, x1, y1, size, bold, height) with kind (header_footer, heading, paragraph) and level.

    A line in the margins whose wording, digits aside, repeats on half the pages is furniture.  A heading has the shape of one and is larger than
    body text or bold; its level is its numbering's, else the rank of its size among unnumbered headings, at most six.
    """
    edge = (F.col("y0") <= F.col("height") * EDGE) | (F.col("y1") >= F.col("height") * (1 - EDGE))
    l = lines.withColumn("key", furniture_key(F.col("text"))).withColumn("edge", edge)
    pages = l.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    repeated = l.where("edge").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on")).join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("n") * REPEAT))).select("doc_id", "key", F.lit(True).alias("edge"), F.lit(True).alias("furniture"))
    l = l.join(repeated, ["doc_id", "key", "edge"], "left").join(body_sizes(lines), "doc_id")
    head = heading_shape(F.col("text")) & ((F.col("size") >= RATIO * F.col("ceiling")) | (F.col("bold") & (F.col("size") >= F.col("dominant"))) | (numbering_level(F.col("text")).isNotNull() & (F.col("size") > F.col("ceiling"))))
    l = l.withColumn("kind", F.when(F.coalesce("furniture", F.lit(False)), "header_footer").when(head, "heading").otherwise("paragraph"))
    l = l.withColumn("numbered", F.when(F.col("kind") == "heading", numbering_level(F.col("text"))))
    by_size = F.dense_rank().over(Window.partitionBy("doc_id", (F.col("kind") == "heading") & F.col("numbered").isNull()).orderBy(F.desc(F.round("size", 1))))
    level = F.when(F.col("kind") == "heading", F.least(F.lit(MAX_LEVEL), F.coalesce("numbered", by_size)))
    return l.withColumn("level", level).select(*lines.columns, "kind", "level")


def blocks(classified: DataFrame) -> DataFrame:
    """Blocks of a document in order: doc_id, ord, page, kind, level, text, section_path.

    A heading replaces those of its level and below on the stack of sections, which lasts over pages; lines of a paragraph
    join with a space until a gap of more than 1.8 sizes or another kind.  The stack depends on all before it, so each document is walked in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        stack: list[tuple[int, str]] = []
        last: dict | None = None
        for r in pdf.sort_values(["page", "i"], kind="stable").to_dict("records"):
            if r["kind"] == "heading":
                while stack and stack[-1][0] >= r["level"]:
                    stack.pop()
                stack.append((int(r["level"]), r["text"].strip()))
            joins = last is not None and r["kind"] == "paragraph" == last["kind"] and r["page"] == last["page"] and r["y0"] - last["y1"] <= GAP * r["size"]
            if joins:
                out[-1]["text"] += " " + r["text"].strip()
            else:
                out.append({"doc_id": r["doc_id"], "ord": len(out), "page": r["page"], "kind": r["kind"], "level": None if r["level"] != r["level"] else r["level"], "text": r["text"].strip(), "section_path": [t for _, t in stack]})
            last = r
        return pd.DataFrame(out, columns=["doc_id", "ord", "page", "kind", "level", "text", "section_path"])

    cols = ["doc_id", "page", "i", "text", "y0", "y1", "size", "kind", "level"]
    return classified.select(*cols).groupBy("doc_id").applyInPandas(run, "doc_id string, ord int, page int, kind string, level int, text string, section_path array<string>")
