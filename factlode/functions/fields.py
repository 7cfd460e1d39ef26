"""Small readers of texts: chart replies, headings, figures with their years, paths, proportions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The three lines of a chart's reply, and what it says where nothing can be read.
CHART_LABELS, UNREADABLE = ("數值", "單位", "依據"), "看不出來"
#: The statement of each account.
STATEMENTS = {
    "balance": ["資產總額", "資產總計", "負債總額", "負債總計", "權益總額", "權益總計", "流動資產", "非流動資產", "流動負債", "非流動負債", "股本", "資本公積", "保留盈餘", "其他權益", "存貨", "現金及約當現金"],
    "income": ["營業收入", "營業成本", "營業毛利", "營業利益", "本期淨利", "本年度淨利", "利息淨收益", "每股盈餘"], "ratio": ["現金流量比率", "現金流量允當比率", "現金再投資比率"],
}
#: What a heading that spans years holds, and the forms of a single year, the most specific first.
SPANS = "[及至~→、]"
YEARS = ["([0-9]{2,3})年12月31日", "([0-9]{2,3})年度", "([0-9]{2,3})年"]
#: Ideographs of digits.
CJK_DIGITS = ("〇○零一二三四五六七八九", "000123456789")


def chart_reply(c: Column) -> Column:
    """value, unit and basis of a reply about a chart; a reply without its form, or one that can't read the chart, has no value."""
    line = lambda label: F.trim(F.regexp_extract(c, rf"(?m)^[ \t]*{label}[：:]([^\r\n]*)$", 1))
    value, unit, basis = (line(x) for x in CHART_LABELS)
    return F.struct(F.when(~value.isin("", UNREADABLE), value).alias("value"), F.when(~unit.isin("", "無"), unit).alias("unit"), basis.alias("basis"))


def heading_period(c: Column) -> Column:
    """The fiscal year of a column's heading; null where it names several years or none."""
    flat = F.regexp_replace(c, r"(?U)\s+", "")
    found = [F.nullif(F.regexp_extract(flat, p, 1), F.lit("")) for p in YEARS]
    return F.when(~flat.rlike(SPANS), F.concat(F.lit("FY"), (F.coalesce(*found).cast("int") + 1911).cast("string")))


def statement_of(account: Column) -> Column:
    """The statement that an account belongs to; null for an account that is not known."""
    return F.create_map(*[F.lit(x) for s, accounts in STATEMENTS.items() for a in accounts for x in (a, s)])[F.trim(account)]


def cjk_number(c: Column) -> Column:
    """A number written digit by digit in ideographs or Arabic digits; null for anything else."""
    t = F.translate(c, *CJK_DIGITS)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def longest_figure(c: Column) -> Column:
    """The longest figure of a text, of equally long ones the first; null without one."""
    found = F.regexp_extract_all(c, F.lit(r"([0-9][0-9,]*(?:[.][0-9]+)?)"), F.lit(1))
    longest = F.array_max(F.transform(found, lambda x: F.length(x)))
    return F.get(F.filter(found, lambda x: F.length(x) == longest), F.lit(0))


def year_values(c: Column, reach: int = 24) -> Column:
    """Years with the figure that follows each within ``reach`` characters that are no digits: an array of (year, value)."""
    pattern = rf"([0-9]{{2,4}})年[^0-9]{{0,{reach}}}?(-?[0-9][0-9,]*(?:[.][0-9]+)?)"
    years, values = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(years.alias("year"), values.alias("value"))


def plain_path(c: Column) -> Column:
    """Whether a path is relative and stays below where it starts, written with single slashes."""
    return F.coalesce((c != "") & ~c.rlike(r"^/|^[A-Za-z]:|\\|(^|/)[.]{1,2}(/|$)|//|/$"), F.lit(False))


def proportion(c: Column) -> Column:
    """n, k and problem of a JSON object with ``n`` and one of correct, valid, refused and passed; a bare rate is refused."""
    get = lambda k: F.get_json_object(c, f"$.{k}")
    n, k = get("n"), F.coalesce(*[get(x) for x in ("correct", "valid", "refused", "passed")])
    whole = n.try_cast("bigint").isNotNull() & k.try_cast("bigint").isNotNull()
    problem = (
        F.when(c.isNull(), "missing").when(~F.coalesce(F.trim(c).startswith("{"), F.lit(False)), "not_an_object").when((n.isNull() | k.isNull()) & get("rate").isNotNull(), "rate_without_count").when(n.isNull() | k.isNull(), "no_count")
        .when(~whole, "not_a_number").when((n.try_cast("bigint") < 0) | (k.try_cast("bigint") < 0) | (k.try_cast("bigint") > n.try_cast("bigint")), "out_of_range")
    )
    return F.struct(F.when(problem.isNull(), n.try_cast("bigint")).alias("n"), F.when(problem.isNull(), k.try_cast("bigint")).alias("k"), problem.alias("problem"))


def stable_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def now_utc() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
