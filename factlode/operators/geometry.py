"""Boxes on pages: overlap, nearest captions, clusters, duplicate tables and reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Thresholds of shape and distance.
SHARE, CAPTION, MARGIN, GAP, AREA, ASPECT, LABELS = 0.5, 60.0, 14.0, 24.0, (0.01, 0.85), 12.0, 3


def _c(b, k: str) -> Column:
    return F.col(f"{b}.{k}") if isinstance(b, str) else b[k]


def area(b) -> Column:
    return F.greatest(_c(b, "x1") - _c(b, "x0"), F.lit(0.0)) * F.greatest(_c(b, "y1") - _c(b, "y0"), F.lit(0.0))


def intersection(a, b) -> Column:
    side = lambda lo, hi: F.greatest(F.least(_c(a, hi), _c(b, hi)) - F.greatest(_c(a, lo), _c(b, lo)), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def iou(a, b) -> Column:
    i = intersection(a, b)
    return F.coalesce(F.try_divide(i, area(a) + area(b) - i), F.lit(0.0))


def overlap_share(a, b) -> Column:
    """The intersection as a part of the smaller box."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def uncovered(blocks: DataFrame, regions: DataFrame, share: float = SHARE) -> DataFrame:
    """Blocks (doc_id, page, bbox) of which no region of their page covers ``share``: joined on the page, then kept apart."""
    r = regions.select(F.col("doc_id").alias("rd"), F.col("page").alias("rp"), F.col("bbox").alias("rb"))
    on = (F.col("doc_id") == F.col("rd")) & (F.col("page") == F.col("rp")) & (intersection("bbox", "rb") >= share * area("bbox")) & (area("bbox") > 0)
    return blocks.join(r, on, "left_anti")


def nearest_caption(figures: DataFrame, captions: DataFrame, reach: float = CAPTION) -> DataFrame:
    """Each figure (doc_id, page, ord, bbox) with the nearest caption (doc_id, page, ord, bbox, text) that overlaps it sideways and lies within ``reach`` above or below."""
    c = captions.select("doc_id", "page", F.col("bbox").alias("cb"), F.col("text").alias("caption"), F.col("ord").alias("caption_ord"))
    j = figures.join(c, ["doc_id", "page"])
    gap = F.greatest(F.col("cb.y0") - F.col("bbox.y1"), F.col("bbox.y0") - F.col("cb.y1"), F.lit(0.0))
    beside = F.least("cb.x1", "bbox.x1") - F.greatest("cb.x0", "bbox.x0")
    near = j.where((beside > 0) & (gap <= reach)).groupBy("doc_id", "page", "ord").agg(F.min_by("caption", F.struct(gap, "caption_ord")).alias("caption"))
    return figures.join(near, ["doc_id", "page", "ord"], "left")


def chart_candidates(figures: DataFrame, tables: DataFrame, words: DataFrame, labels: int = LABELS) -> DataFrame:
    """Figures of a fit shape that no table covers and beside which at least ``labels`` numeric words stand: with numeric_labels.

    figures: doc_id, page, ord, bbox, page_area; words: doc_id, page, text, bbox.
    """
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    part = area("bbox") / F.col("page_area")
    fit = figures.where((w > 0) & (h > 0) & part.between(*AREA) & (F.greatest(w / h, h / w) <= ASPECT))
    free = uncovered(fit, tables)
    n = words.where(F.col("text").rlike(r"^[(（]?-?[0-9][0-9,.]*%?[)）]?$")).select("doc_id", "page", F.col("bbox").alias("wb"))
    near = (F.col("wb.x0") >= F.col("bbox.x0") - MARGIN) & (F.col("wb.x1") <= F.col("bbox.x1") + MARGIN) & (F.col("wb.y0") >= F.col("bbox.y0") - MARGIN) & (F.col("wb.y1") <= F.col("bbox.y1") + MARGIN)
    count = free.join(n, ["doc_id", "page"]).where(near).groupBy("doc_id", "page", "ord").agg(F.count(F.lit(1)).alias("numeric_labels"))
    return free.join(count, ["doc_id", "page", "ord"]).where(F.col("numeric_labels") >= labels)


def cluster_boxes(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """Boxes (doc_id, page, bbox) of a page grown together while within ``gap``: doc_id, page, bbox, paths.  Order-dependent, so page by page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = sorted(([b["x0"], b["y0"], b["x1"], b["y1"], 1] for b in pdf["bbox"]), key=lambda b: b[:4])
        merged = True
        while merged:
            merged, out = False, []
            for b in todo:
                for o in out:
                    if b[0] - gap <= o[2] and o[0] - gap <= b[2] and b[1] - gap <= o[3] and o[1] - gap <= b[3]:
                        o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3]), o[4] + b[4]]
                        merged = True
                        break
                else:
                    out.append(list(b))
            todo = out
        return pd.DataFrame([{"doc_id": pdf["doc_id"].iloc[0], "page": pdf["page"].iloc[0], "bbox": dict(zip(("x0", "y0", "x1", "y1"), b[:4])), "paths": b[4]} for b in todo])

    return boxes.select("doc_id", "page", "bbox").groupBy("doc_id", "page").applyInPandas(run, "doc_id string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, paths int")


def dedupe_tables(tables: DataFrame, share: float = SHARE) -> DataFrame:
    """Of tables (doc_id, page, ord, bbox, numeric_cells, cells) that overlap on a page the first keeps its place, the fuller its content.  Greedy in order, so page by page."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for t in pdf.sort_values("ord", kind="stable").to_dict("records"):
            b = t["bbox"]
            for i, k in enumerate(kept):
                o = k["bbox"]
                inter = max(0.0, min(b["x1"], o["x1"]) - max(b["x0"], o["x0"])) * max(0.0, min(b["y1"], o["y1"]) - max(b["y0"], o["y0"]))
                least = min((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), (o["x1"] - o["x0"]) * (o["y1"] - o["y0"]))
                if least > 0 and inter / least >= share:
                    if (t["numeric_cells"], t["cells"]) > (k["numeric_cells"], k["cells"]):
                        kept[i] = t
                    break
            else:
                kept.append(t)
        return pd.DataFrame(kept, columns=pdf.columns)

    return tables.groupBy("doc_id", "page").applyInPandas(run, tables.schema)


def continuations(tables: DataFrame, top: float = 0.25, bottom: float = 0.6) -> DataFrame:
    """Tables (doc_id, page, ord, n_cols, y0, y1 as parts of the page) with the page before whose table they go on with: continues_from_page."""
    prev = tables.where(F.col("y1") >= bottom).select("doc_id", (F.col("page") + 1).alias("page"), "n_cols", F.col("ord").alias("po"))
    j = tables.where(F.col("y0") <= top).join(prev, ["doc_id", "page", "n_cols"]).select("doc_id", "page", "ord").distinct().withColumn("continues_from_page", F.col("page") - 1)
    return tables.join(j, ["doc_id", "page", "ord"], "left")


def reading_order(blocks: DataFrame, band: float = 3.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """Blocks numbered by bands of ``band`` points from the top, then from the left, then by ``ties``."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.bround(F.col("bbox.y0") / band), "bbox.x0", *ties)
    return blocks.withColumn("reading_order", F.row_number().over(w) - 1)


def page_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The box around all boxes of each key."""
    return boxes.groupBy(*keys).agg(F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox"))


def overlapping(boxes: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """Pairs of boxes (``key``, doc_id, page, bbox) of one page of which the smaller lies in the other by ``share`` or more: key_1 < key_2, overlap, iou."""
    side = lambda n: boxes.select("doc_id", "page", F.col(key).alias(f"{key}_{n}"), F.col("bbox").alias(f"b{n}"))
    j = side(1).join(side(2), ["doc_id", "page"]).where(F.col(f"{key}_1") < F.col(f"{key}_2"))
    part = overlap_share("b1", "b2")
    return j.where(part >= share).select("doc_id", "page", f"{key}_1", f"{key}_2", F.round(part, 6).alias("overlap"), F.round(iou("b1", "b2"), 6).alias("iou"))


def words_in(words: DataFrame, boxes: DataFrame, key: str, slack: float = 0.5) -> DataFrame:
    """Words (doc_id, page, text, bbox) inside a box (``key``, doc_id, page, bbox) but for ``slack`` points: ``key``, text."""
    w = words.select("doc_id", "page", "text", F.col("bbox").alias("w"))
    j = w.join(boxes.select(key, "doc_id", "page", F.col("bbox").alias("b")), ["doc_id", "page"])
    return j.where((F.col("w.x0") >= F.col("b.x0") - slack) & (F.col("w.x1") <= F.col("b.x1") + slack) & (F.col("w.y0") >= F.col("b.y0") - slack) & (F.col("w.y1") <= F.col("b.y1") + slack)).select(key, "doc_id", "page", "text")


def same_row(labels: DataFrame, values: DataFrame, key: str, reach: float = 12.0) -> DataFrame:
    """Values (doc_id, page, text, bbox) whose middle lies within ``reach`` points of that of a label (``key``, doc_id, page, bbox), up or down."""
    mid = lambda b: (F.col(f"{b}.y0") + F.col(f"{b}.y1")) / 2
    j = labels.select(key, "doc_id", "page", F.col("bbox").alias("a")).join(values.select("doc_id", "page", "text", F.col("bbox").alias("b")), ["doc_id", "page"])
    return j.where(F.abs(mid("a") - mid("b")) <= reach).select(key, "doc_id", "page", "text")


def assemble(blocks: DataFrame, tables: DataFrame, share: float = SHARE) -> DataFrame:
    """One order of what a page holds: tables, and blocks that no table covers by ``share``, by height and then from the left: doc_id, page, ord, is_table, place.

    A table goes before the text that it was made of; covered blocks are left out.
    """
    kept = uncovered(blocks, tables, share).select("doc_id", "page", "ord", "bbox", F.lit(False).alias("is_table"))
    every = kept.unionByName(tables.select("doc_id", "page", "ord", "bbox", F.lit(True).alias("is_table")))
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("bbox.y0", "bbox.x0", F.desc("is_table"), "ord", "bbox.x1", "bbox.y1"))
    return every.select("doc_id", "page", "ord", "is_table", place.alias("place"))
