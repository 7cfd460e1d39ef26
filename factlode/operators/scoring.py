"""Answers and citations scored against what was recorded."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pandas as pd
import regex as re
import unicodedata
from pyspark.sql import Column, DataFrame, functions as F, types as T

from factlode.functions.text import is_refusal, no_space, normal_text, roc_to_common_era
from factlode.operators.facts import canonical_unit

#: Magnitude words after a figure.
MAGNITUDE = {"億": 10**8, "萬": 10**4, "千": 10**3}
_FIGURE = re.compile(r"-?\d+(?:\.\d+)?")


def figures(text: str | None, unit: str | None) -> list[Decimal]:
    """The figures of an answer in order: brackets are a minus, the declared unit goes, magnitude words multiply, years are labels."""
    flat = "".join(unicodedata.normalize("NFKC", text or "").replace(",", "").split())
    flat = re.sub(r"\((\d[\d.]*)\)", r"-\1", flat)
    if unit and unit.strip():
        flat = re.sub(r"(?<=\d)" + re.escape(unicodedata.normalize("NFKC", unit).strip()), " ", flat)
    for word, scale in MAGNITUDE.items():
        flat = re.sub(rf"(-?\d+(?:\.\d+)?){word}", lambda m, s=scale: str(Decimal(m[1]) * s), flat)
    return [Decimal(x) for x in _FIGURE.findall(re.sub(r"-?\d+(?:\.\d+)?年", " ", flat))]


def numbers_agree(got: list[Decimal], wanted: list[Decimal], kind: str | None, value: float | None) -> bool | None:
    """As many figures, each within tolerance; null where none is wanted.  A wanted zero admits zero only (relative)."""
    if not wanted:
        return None
    if len(got) != len(wanted):
        return False
    tol = Decimal(str(value)) if value is not None else Decimal(0)
    for a, b in zip(got, wanted):
        gap = abs(a - b)
        if kind == "absolute":
            ok = gap <= tol
        elif kind == "relative" and b != 0:
            ok = gap <= tol * abs(b)
        else:
            ok = gap == 0
        if not ok:
            return False
    return True


@F.pandas_udf(T.BooleanType())
def numeric_match(got: pd.Series, wanted: pd.Series, unit: pd.Series, kind: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else numbers_agree(figures(g, u), figures(w, u), k, None if v is None or v != v else float(v)) for g, w, u, k, v in zip(got, wanted, unit, kind, value)], dtype=object)


def bigram_f1(a: str | None, b: str | None) -> float | None:
    """Harmonic mean of precision and recall of two texts' bigrams with repetition: 1 where both are empty."""
    if a is None or b is None:
        return None
    grams = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1)) if len(t) > 1 else Counter([t] if t else [])
    x, y = grams(a), grams(b)
    size = x.total() + y.total()
    return 2.0 * (x & y).total() / size if size else 1.0


@F.pandas_udf(T.DoubleType())
def _f1(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bigram_f1(x, y) for x, y in zip(a, b)], dtype=float)


def token_f1(a: Column, b: Column) -> Column:
    return _f1(normal_text(a), normal_text(b))


def default_tolerance(unit: Column) -> Column:
    """0.1 absolute for percentages, else 0.005 relative."""
    return F.when(canonical_unit(unit) == "%", F.struct(F.lit("absolute").alias("type"), F.lit(0.1).alias("value"))).otherwise(F.struct(F.lit("relative").alias("type"), F.lit(0.005).alias("value")))


def score_answers(answers: DataFrame) -> DataFrame:
    """question_id and the verdicts on ``predicted``: exact, f1, numeric, unit_ok, period_ok, refused, should_refuse, correct.

    answers: question_id, answer, acceptable_variants, unit, period, tolerance, answerable, predicted, predicted_unit, predicted_period.
    A verdict that does not apply is null, which is not false.  An unanswerable question is correct if refused, an
    answerable one if exact or all its figures agree, with unit and period right.
    """
    same = lambda c: normal_text(roc_to_common_era(c))
    a = answers.withColumn("p", same(F.coalesce("predicted", F.lit("")))).withColumn("w", same(F.col("answer")))
    a = a.withColumn("vs", F.transform(F.coalesce("acceptable_variants", F.array().cast("array<string>")), lambda v: F.lower(no_space(F.replace(v, F.lit(","), F.lit(""))))))
    exact = F.coalesce(F.col("p") == F.col("w"), F.lit(False)) | F.array_contains("vs", F.col("p"))
    a = a.withColumn("exact", exact).withColumn("refused", is_refusal(F.coalesce("predicted", F.lit(""))))
    a = a.withColumn("numeric", numeric_match(F.coalesce("predicted", F.lit("")), F.col("answer"), F.col("unit"), F.col("tolerance.type"), F.col("tolerance.value")))
    a = a.withColumn("f1", F.round(_f1(F.col("p"), F.col("w")), 6))
    unit_ok = F.when(F.col("unit").isNotNull(), F.coalesce(canonical_unit(F.col("predicted_unit")) == canonical_unit(F.col("unit")), F.lit(False)))
    period_ok = F.coalesce(same(F.col("predicted_period")) == same(F.col("period")), F.lit(False))
    a = a.withColumn("unit_ok", unit_ok).withColumn("period_ok", period_ok)
    right = F.when(~F.col("answerable"), F.col("refused")).otherwise(~F.col("refused") & (F.coalesce("numeric", F.lit(False)) | F.col("exact")) & F.coalesce("unit_ok", F.lit(True)) & F.col("period_ok"))
    return a.select("question_id", "exact", "f1", "numeric", "unit_ok", "period_ok", "refused", (~F.col("answerable")).alias("should_refuse"), right.alias("correct"))


def protocol_correct(least: float = 0.8) -> Column:
    """Correctness to the letter, over the verdicts of score_answers: refusals and figures decide where they apply, else exact or f1 of at least ``least``."""
    return F.when(F.col("should_refuse"), F.col("refused")).when(F.col("refused"), False).otherwise(F.coalesce("numeric", F.col("exact") | F.coalesce(F.col("f1") >= least, F.lit(False))))


def figure_text(c: Column) -> Column:
    """A decimal as filings print it: thousands apart, two places only if it has a fraction (half to even)."""
    return F.when(c % 1 != 0, F.format_number(F.bround(c, 2), 2)).otherwise(F.format_number(c, 0))


def amount_text(c: Column) -> Column:
    """A decimal as an answer states it: thousands apart, up to two places without closing zeros (half to even); null is a refusal."""
    return F.coalesce(F.regexp_replace(F.format_number(F.bround(c, 2), 2), r"[.]?0+$", ""), F.lit("無法回答"))


_ATOM = re.compile(r"[0-9][0-9.]+|[A-Za-z]{2,}|[\u4e00-\u9fff]{2,}")


def _one_form(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).split()).translate(str.maketrans("仟臺", "千台"))


def holds(claim: str | None, evidence: str | None) -> bool | None:
    """Whether evidence holds a claim: as it stands without white space, without separators, or by every figure and term it has."""
    if claim is None or evidence is None:
        return None
    c, e = _one_form(claim), _one_form(evidence)
    bare = lambda x: x.replace(",", "")
    atoms = _ATOM.findall(bare(c))
    return c in e or bare(c) in bare(e) or bool(atoms) and all(a in bare(e) for a in atoms)


@F.pandas_udf(T.BooleanType())
def supports(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    return pd.Series([holds(c, e) for c, e in zip(claim, evidence)], dtype=object)


def corroborate(answers: DataFrame, cited: DataFrame, pages: DataFrame) -> DataFrame:
    """Where the filings that a question cites hold its recorded answer: query, verdict, pages (that hold it).

    answers: query, answer; cited: query, doc, page; pages: doc, page, text.  cited: a cited page holds it; elsewhere: another page of those
    filings does; partial: a page holds one of its figures or terms; absent: none; unverifiable: the answer has neither figure nor term.
    """
    docs = cited.select("query", "doc").distinct()
    own = cited.select("query", "doc", "page", F.lit(True).alias("own")).distinct()
    a = answers.where("answer is not null")
    j = a.join(docs, "query").join(pages, "doc").join(own, ["query", "doc", "page"], "left")
    j = j.withColumn("all", F.coalesce(supports("answer", "text"), F.lit(False))).withColumn("some", F.coalesce(touches("answer", "text"), F.lit(False)))
    g = j.groupBy("query").agg(F.count_if(F.col("all") & F.col("own").isNotNull()).alias("here"), F.count_if("all").alias("pages"), F.count_if("some").alias("some"))
    verdict = F.when(~has_atoms("answer"), "unverifiable").when(F.col("here") > 0, "cited").when(F.col("pages") > 0, "elsewhere").when(F.col("some") > 0, "partial").otherwise("absent")
    return a.join(g, "query", "left").select("query", verdict.alias("verdict"), F.coalesce("pages", F.lit(0)).alias("pages"))


@F.pandas_udf(T.BooleanType())
def touches(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    """Whether evidence holds one of the figures and terms of a claim."""
    bare = lambda x: _one_form(x).replace(",", "")
    return pd.Series([None if c is None or e is None else any(x in bare(e) for x in _ATOM.findall(bare(c))) for c, e in zip(claim, evidence)], dtype=object)


@F.pandas_udf(T.BooleanType())
def has_atoms(claim: pd.Series) -> pd.Series:
    return pd.Series([bool(_ATOM.search(_one_form(c or "").replace(",", ""))) for c in claim], dtype=bool)
