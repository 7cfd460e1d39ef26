"""Splitting oversized texts at their own pauses."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factlode.llm.bpe import WHITE

LIMIT, OVERLAP = 1200, 100
#: How far from its target a cut may lie, as a part of the step.
REACH = 0.25

_EDGE = "".join(map(chr, WHITE))
_LINE = "\n\r\x0b\x0c\x85\u2028\u2029"
#: Boundaries from the strongest; each match ends where the cut may lie.
_PAUSES = [
    (5, re.compile(rf"(?:\r\n|[{_LINE}])[ \t　]*(?:\r\n|[{_LINE}])+")),
    (4, re.compile(rf"(?:\r\n|\r(?!\n)|[{_LINE.replace(chr(13), '')}])")),
    (3, re.compile(r"[。！？!?]+[」』）\"'”’)]*|\.(?=\s)")),
    (2, re.compile(r"[；;：:，,、](?![0-9])")),
    (1, re.compile(r"\s+")),
]


def _snap(text: str, low: int, high: int, target: int) -> tuple[int, int] | None:
    """The strongest pause that ends in [low, high], of equals the nearest to the target: its end and strength."""
    if low > high:
        return None
    start = max(0, low - 8)
    for strength, pause in _PAUSES:
        ends = [m.end() for m in pause.finditer(text, start, min(len(text), high + 1)) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e)), strength
    return None


def _hard(text: str, low: int, high: int, target: int) -> int:
    """A cut that parts no line end and no character from its marks, where that is possible."""
    for cut in sorted(range(low, high + 1), key=lambda e: (abs(e - target), e)):
        if not (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0e\ufe0f" or text[cut - 1 : cut + 1] == "\r\n"):
            return cut
    return target


def _longest_run(text: str) -> int:
    """The most characters between the ends of two pauses."""
    ends = sorted({0, len(text), *(m.end() for _, pause in _PAUSES for m in pause.finditer(text))})
    return max(b - a for a, b in zip(ends, ends[1:]))


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Where pieces of ``text`` end, each with the strength of its boundary (5 paragraph, 4 line, 3 sentence, 2 clause, 1 space, 0 none).

    Piece k runs from ``overlap`` before the end of piece k - 1 to its own end.
    """
    n, step = len(text), limit - overlap
    if n <= limit:
        return [(n, 5)]
    least = math.ceil((n - overlap) / step)
    hopeless = False  # some stretch without a pause is longer than any reach
    most = max(least, math.ceil((n - overlap) / max(1, int(step * (1 - REACH)))))  # beyond that, reaches leave nothing new to try
    for count in (*range(least, most + 1), -least):
        if count == least + 1 and _longest_run(text) > step:
            hopeless = True
        if hopeless and count > 0:
            continue
        pieces = abs(count)
        even = (n + (pieces - 1) * overlap) / pieces - overlap
        found, last = [], overlap
        for k in range(1, pieces):
            target = round(overlap + k * even)
            high = min(last + step, n - 1, target + int(REACH * step))
            low = max(last + 1, n - (pieces - k) * step, target - int(REACH * step))
            if low > high:  # earlier cuts leave no room: aim at what is left
                low = max(last + 1, n - (pieces - k) * step)
                high = max(low, min(last + step, n - 1))
            at = _snap(text, low, high, target)
            if at is None and count > 0:
                break
            at = at or (_hard(text, low, high, min(max(target, low), high)), 0)
            found.append(at)
            last = at[0]
        else:
            return [*found, (n, 5)]
    raise AssertionError("the last pass always cuts")


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """Pieces of a text without its outer white space; start counts from the first character of the text as given."""
    if text is None:
        return []
    inner = text.lstrip(_EDGE)
    shift, inner = len(text) - len(inner), inner.rstrip(_EDGE)
    if not inner:
        return []
    begin, out = 0, []
    for end, strength in cuts(inner, limit, overlap):
        out.append({"start": shift + begin, "text": inner[begin:end], "boundary": strength})
        begin = end - overlap
    return out


def split_oversized(df: DataFrame, text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows whose ``text_col``, outer white space aside, has more than ``limit`` characters, as one row per piece.

    A piece keeps every column of its row; ``text_col`` becomes the piece, and ``piece`` (from 1), ``pieces``, ``piece_start`` and ``boundary``
    (strength of the pause at its end) come behind them, replacing columns of those names.
    The least number of pieces is taken, their ends are aimed at equal lengths and each is moved to the strongest pause near
    by.  Where some end finds no pause in reach, more pieces are tried,
    until the reaches of their ends cover every place, and only then is a text cut without one.
    Null, empty, blank and shorter texts give no row.  Repeated rows are split each.  Needs 0 <= overlap < limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and the limit")

    @F.pandas_udf("array<struct<start:int,text:string,boundary:int>>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: p if len(p := split_text(t, limit, overlap)) > 1 else [])

    ours = ["piece", "pieces", "piece_start", "boundary"]
    kept = [c for c in df.columns if c.lower() not in ours]
    src = df.select(*kept).where(F.length(text_col) > limit)
    taken = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("r")
    rows = src.select(taken, parts(F.col(text_col).cast("string")).alias("p")).where(F.size("p") > 1)
    rows = rows.select("r", F.size("p").alias("n"), F.posexplode("p").alias("k", "one"))
    cols = [F.col("one.text").alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in kept]
    return rows.select(*cols, (F.col("k") + 1).alias("piece"), F.col("n").alias("pieces"), F.col("one.start").alias("piece_start"), F.col("one.boundary").alias("boundary"))
