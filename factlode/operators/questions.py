"""Questions: routes, periods and what a numeric question asks for."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The wordings that decide a route, in their order of precedence.
METADATA = "文件(?:名稱|類型|日期)|報告(?:期間|年度)為何|由誰簽核|會計師事務所名稱"
CHART = "圖|走勢|趨勢|柱狀|折線|圓餅|座標|圖例|示意"
CROSS = "年報與|財報與|兩份|不同文件|跨文件|與.*報告(?:書)?(?:相比|對照)"
COMPUTED = "比率|比重|佔|占|成長|年增|增減|變動(?:比例|幅度)?|相比|差異|減去|合計佔"
PRINTED = "多少|金額|總計|總額|營收|營業收入|營業成本|淨利|每股|資產|負債|權益|盈餘"
#: Accounts a question can name, with their spellings.
ACCOUNTS = {
    "資產總計": ["資產總計", "資產總額", "總資產"], "負債總計": ["負債總計", "負債總額", "總負債"], "權益總計": ["權益總計", "權益總額", "股東權益總計", "淨值"], "保留盈餘": ["保留盈餘"], "營業收入": ["營業收入", "營收"],
    "營業成本": ["營業成本"], "本期淨利": ["本期淨利", "稅後淨利", "稅後純益"], "非流動資產": ["非流動資產"], "非流動負債": ["非流動負債"], "流動資產": ["流動資產"], "流動負債": ["流動負債"],
}
#: A gloss of units in brackets, and the wordings that tell what is computed: a share, several figures, a change, a change in percent.
GLOSS = "[（(]\\s*每[^）)]{1,30}[）)]"
SHARE, SEVERAL, CHANGE, PERCENT = "佔|占|比率|比重|占比", "分別|(?:是多少.*){2,}", "成長|增減|變動|年增|較.*(?:增加|減少)", "比例|比率|率|幅度|百分比|成長|年增"
#: The route of each question type.
ROUTE_OF = {"narrative_fact": "narrative", "table_cell": "chart", "numeric_calculation": "numeric", "cross_period_comparison": "numeric", "chart_value_trend": "chart", "cross_page": "narrative", "cross_document": "cross_modal", "unanswerable": "unanswerable"}


def periods(c: Column) -> Column:
    """The distinct fiscal years a text names, years of the republic and of the common era as one (``(?<!digit)`` keeps 2023年 from reading as 23年)."""
    years = F.regexp_extract_all(c, F.lit(r"(?:FY([0-9]{4}))|(?:(?<![0-9])([0-9]{2,4})\s*年)"), F.lit(0))
    number = lambda y: F.regexp_extract(y, "([0-9]+)", 1).cast("int")
    return F.array_sort(F.array_distinct(F.transform(years, lambda y: F.when(number(y) < 1000, number(y) + 1911).otherwise(number(y)))))


def route(c: Column) -> Column:
    """The route of a question: metadata, chart, cross_modal, numeric (two periods or arithmetic), chart (a printed value), narrative."""
    return (
        F.when(c.rlike(METADATA), "metadata").when(c.rlike(CHART), "chart").when(c.rlike(CROSS), "cross_modal").when(F.size(periods(c)) >= 2, "numeric").when(c.rlike(COMPUTED), "numeric").when(c.rlike(PRINTED), "chart").otherwise("narrative")
    )


def confidence(c: Column) -> Column:
    r = route(c)
    return F.when(r == "narrative", 0.5).when((r == "metadata") | (r == "cross_modal") | ((r == "chart") & ~c.rlike(CHART)), 0.6).otherwise(0.7)


def effective_route(question_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROUTE_OF.items() for x in kv])[question_type]


def accounts(c: Column) -> Column:
    """Canonical accounts in the order they are named.  A name inside a longer one, or only in a bracketed per-unit gloss, is not named."""
    subject = F.regexp_replace(c, GLOSS, "")
    spelt = sorted(((s, a) for a, ss in ACCOUNTS.items() for s in ss), key=lambda x: (-len(x[0]), x[0]))
    found = F.regexp_extract_all(subject, F.lit("(" + "|".join(s for s, _ in spelt) + ")"), F.lit(1))
    of = F.create_map(*[F.lit(x) for s, a in spelt for x in (s, a)])
    return F.array_distinct(F.transform(found, lambda s: of[s]))


def numeric_kind(c: Column) -> Column:
    """ratio, growth, delta or lookup; null where no account is named or several figures are asked for."""
    n = F.size(accounts(c))
    return (
        F.when(n == 0, None).when(c.rlike(SHARE) & (n >= 2), "ratio").when(c.rlike(SEVERAL), None)
        .when(c.rlike(CHANGE), F.when(c.rlike(PERCENT), "growth").otherwise("delta")).otherwise("lookup")
    )
