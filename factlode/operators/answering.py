"""From a question to a scored answer: figures from the store, the choice of a path, the rungs of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factlode.functions.text import is_refusal, roc_period
from factlode.operators import facts as X, questions as Q
from factlode.operators.answers import parse_answer
from factlode.operators.scoring import amount_text

#: Fixed value: what a refusal says.
REFUSED = "無法回答"
#: The rungs of the ladder and what each adds: retrieval, and whether figures, charts and committed routes are in use.
LADDER = [
    ("F0", "baseline", "lexical", False, False, False), ("F1", "candidate", "lexical", False, False, False), ("F2", "candidate", "hybrid", False, False, False), ("F3", "candidate", "rerank", False, False, False),
    ("F4", "candidate", "rerank", True, False, False), ("F5", "candidate_captioned", "rerank", True, False, False), ("F6", "candidate_captioned", "rerank", True, True, False), ("F7", "candidate_captioned", "rerank", True, True, True),
]
_RUNG = "array<struct<factor:string,parser:string,mode:string,numeric:boolean,chart:boolean,committed:boolean>>"


def _figures(facts: DataFrame) -> DataFrame:
    """Figures by point under the canonical names of their accounts: n records, and the one there is if there is one."""
    spelt = F.create_map(*[F.lit(x) for a, ss in Q.ACCOUNTS.items() for s in ss for x in (s, a)])
    f = facts.withColumn("account", spelt[F.col("account")]).where("account is not null")
    f = X.last_wins(f.select(*X.KEY, "value", "unit", "currency", "unit_is_uniform", "loaded_at", "line_id"), X.KEY, ["loaded_at", "line_id"])
    one = F.struct("value", "unit", "currency", "unit_is_uniform", X.citation().alias("ref"))
    return f.groupBy(*X.POINT).agg(F.count(F.lit(1)).alias("n"), F.max_by(one, F.struct("loaded_at", "line_id")).alias("f"))


def answer_numerically(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Each question's figure from the store, or why there is none: question_id, kind, period, value, unit, formula, operands, source_refs, answer, status.

    questions: question_id, company_code, question, statement_basis (null: consolidated).  The wording gives the account or
    accounts, the year and the kind (see ``numeric_kind``); growth and delta are against the year before.

    status: OK, unparsed (no company, year, account or kind is recognised), no_figure, ambiguous (several records of a point), no_value,
    or the rule of comparability that two figures break, zero_base and zero_denominator among them.  A refusal has no value and answers so.
    """
    q = questions.select("question_id", "company_code", F.coalesce("statement_basis", F.lit("consolidated")).alias("basis"), Q.accounts(F.col("question")).alias("accounts"), Q.numeric_kind(F.col("question")).alias("kind"), roc_period(F.col("question")).alias("period"))
    change = F.col("kind").isin("growth", "delta")
    before = F.concat(F.lit("FY"), (F.substring("period", 3, 4).cast("int") - 1).cast("string"))
    q = q.select("*", F.get("accounts", F.lit(0)).alias("account_1"), F.when(F.col("kind") == "ratio", F.get("accounts", F.lit(1))).when(change, F.get("accounts", F.lit(0))).alias("account_2"), F.when(change, before).otherwise(F.col("period")).alias("period_2"))
    fig = _figures(facts)
    side = lambda n: fig.select(F.col("company_code"), F.col("basis"), F.col("account").alias(f"account_{n}"), F.col("period").alias("period" if n == 1 else "period_2"), F.col("n").alias(f"n_{n}"), F.col("f").alias(f"f{n}"))
    j = q.join(side(1), ["company_code", "basis", "account_1", "period"], "left").join(side(2), ["company_code", "basis", "account_2", "period_2"], "left")
    two = F.col("account_2").isNotNull()
    a, b = F.col("f1.value"), F.col("f2.value")
    zero = F.when(b == 0, F.when(F.col("kind") == "ratio", "zero_denominator").when(F.col("kind") == "growth", "zero_base"))
    status = (
        F.when(F.col("company_code").isNull() | F.col("period").isNull() | F.col("kind").isNull(), "unparsed").when(F.col("n_1").isNull() | (two & F.col("n_2").isNull()), "no_figure").when((F.col("n_1") > 1) | (two & (F.col("n_2") > 1)), "ambiguous")
        .when(~two & a.isNull(), "no_value").when(two, F.coalesce(X.refusal("f1", "f2"), zero)).otherwise(F.lit(None))
    )
    j = j.withColumn("status", F.coalesce(status, F.lit("OK")))
    ok = F.col("status") == "OK"
    value = F.when(F.col("kind") == "lookup", a.cast("decimal(38,6)")).when(F.col("kind") == "delta", (a - b).cast("decimal(38,6)")).when(F.col("kind") == "ratio", X.percent(a, b).cast("decimal(38,6)")).otherwise(X.percent(a - b, b).cast("decimal(38,6)"))
    unit = F.when(F.col("kind").isin("lookup", "delta"), X.canonical_unit(F.col("f1.unit"))).otherwise("%")
    formula = F.when(F.col("kind") == "lookup", F.col("account_1")).when(F.col("kind") == "delta", F.format_string("%s %s - %s", "account_1", "period", "period_2")).when(F.col("kind") == "ratio", F.format_string("%s / %s * 100", "account_1", "account_2")).otherwise(F.format_string("%s (%s - %s) / %s * 100", "account_1", "period", "period_2", "period_2"))
    term = lambda acc, per, v: F.concat(F.col(acc), F.lit(" "), F.col(per), F.lit("="), v.cast("string"))
    both = lambda x, y: F.when(ok, F.array_join(F.array_compact(F.array(x, F.when(two, y))), "; "))
    out = j.select(
        "question_id", "kind", "period", F.when(ok, value).alias("value"), F.when(ok, unit).alias("unit"), F.when(ok, formula).alias("formula"), both(term("account_1", "period", a), term("account_2", "period_2", b)).alias("operands"), both(F.col("f1.ref"), F.col("f2.ref")).alias("source_refs"), "status",
    )
    return out.withColumn("answer", amount_text(F.col("value")))


def dispatch(rows: DataFrame, committed: Column) -> DataFrame:
    """``rows`` with the answer that stands: said, said_unit, said_period, handled_route.

    rows: route (by the wording), figure, figure_unit, figure_period (null without), chart_value, chart_unit (null without),
    reply (of the generator).  A figure goes before a chart's value, that before the reply; a committed route of figures or charts
    that finds nothing refuses instead of asking the generator.
    """
    from_figure, from_chart = F.col("figure").isNotNull(), F.col("chart_value").isNotNull()
    refuses = committed & F.col("route").isin("numeric", "chart")
    r = rows.withColumn("parsed", parse_answer(F.coalesce("reply", F.lit(""))))
    pick = lambda f, c, g: F.when(from_figure, f).when(from_chart, c).when(~refuses, g)
    none = F.lit(None).cast("string")
    out = r.withColumn("said", F.coalesce(pick(F.col("figure"), F.col("chart_value"), F.col("parsed.answer")), F.lit(REFUSED))).withColumn("said_unit", pick(F.col("figure_unit"), F.col("chart_unit"), F.col("parsed.unit"))).withColumn("said_period", pick(F.col("figure_period"), none, F.col("parsed.period")))
    handled = F.when(from_figure, "numeric").when(from_chart, "chart").when(committed, F.col("route")).otherwise("narrative")
    return out.withColumn("handled_route", handled).drop("parsed")


def climb(questions: DataFrame, met: DataFrame) -> DataFrame:
    """Every question on every rung of the ladder, in one plan: question_id, factor, mode, route, handled_route, said, said_unit, said_period, refused, cited_ok.

    questions: question_id and the columns of ``dispatch``; met: query, mode, met (whether what that retrieval found covers a place
    that the question's evidence names).  A refusal cites nothing (null); so does a question without evidence.
    """
    rungs = F.from_json(F.lit("[" + ",".join("{" + f'"factor":"{f}","parser":"{p}","mode":"{m}","numeric":{str(n).lower()},"chart":{str(c).lower()},"committed":{str(t).lower()}' + "}" for f, p, m, n, c, t in LADDER) + "]"), _RUNG)
    each = questions.withColumn("rung", F.explode(rungs)).select("*", "rung.factor", "rung.mode", "rung.committed")
    for c, on in (("figure", "numeric"), ("chart_value", "chart")):
        each = each.withColumn(c, F.when(F.col(f"rung.{on}"), F.col(c)))
    done = dispatch(each, F.col("committed")).withColumn("refused", is_refusal(F.col("said")))
    done = done.join(met.withColumnRenamed("query", "question_id"), ["question_id", "mode"], "left")
    return done.select("question_id", "factor", "mode", F.when(F.col("refused"), "unanswerable").otherwise(F.col("route")).alias("route"), "handled_route", "said", "said_unit", "said_period", "refused", F.when(~F.col("refused"), F.col("met")).alias("cited_ok"))


def summary(graded: DataFrame, by: list[str]) -> DataFrame:
    """Counts with their denominators per ``by``, one row per measure: measure, n, k, rate (null without a denominator).

    graded: answerable, category, gold_route, route, handled_route, refused, correct, cited_ok.
    """
    scopes = {
        "accuracy": ("true", "correct"), "citation": ("cited_ok is not null", "cited_ok"), "numeric_route": ("category in ('numeric_calculation', 'cross_period_comparison') and answerable and handled_route = 'numeric'", "correct"),
        "route": ("true", "route = gold_route"), "over_answer": ("category = 'unanswerable'", "not refused"), "refusal_precision": ("refused", "not answerable"),
    }
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.coalesce(F.expr(s), F.lit(False)).alias("in_scope"), F.coalesce(F.expr(h), F.lit(False)).alias("hit")) for m, (s, h) in scopes.items()])
    g = graded.select(*by, F.explode(each).alias("m")).groupBy(*by, "m.measure").agg(F.count_if("m.in_scope").alias("n"), F.count_if(F.col("m.in_scope") & F.col("m.hit")).alias("k"))
    return g.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("k") / F.col("n"), 6)))
