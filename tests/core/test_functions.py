"""Column functions on literal rows with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from factlode.functions import keys, stats, text as X
from factlode.functions.unit_text import parse_account, parse_note, parse_unit, recorded


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = one(spark, ["毛利率 66.25%", "530,738,356 千元", "附註.本期", "元", "ＡＢ１２ x", None, "", "a.5 1.2.3"], X.tokens)
    assert got == [["毛利", "利率", "66.25"], ["530,738,356", "千元"], ["附註", "本期"], ["元"], ["ab12", "x"], [], [], ["a", "5", "1.2.3"]]


def test_normal_text_and_years(spark):
    assert one(spark, ["新臺幣 １,２００元", "ABCß", None], X.normal_text) == ["twd1200元", "abcss", None]
    assert one(spark, ["民國112年度", "2023年", "112 年至113年", None], X.roc_to_common_era) == ["2023年度", "2023年", "2023年至2024年", None]
    assert one(spark, ["民國112年度", "2023 年度（民國112年度）", "fy2021", "沒有", None], X.roc_period) == ["FY2023", "FY2023", "FY2021", None, None]


def test_amounts(spark):
    got = one(spark, ["(1,234)", "（５６．７）", "12.5%", "-", "不適用", "", None, "1e3", "-7", "N/A", "無"], X.parse_amount)
    assert [None if x is None else float(x) for x in got] == [-1234, -56.7, 12.5, None, None, None, None, 1000, -7, None, None]


def test_grams_and_jaccard(spark):
    assert one(spark, ["ab c", "a", "", None, "aaaa"], X.gram_set) == [["ab", "bc"], ["a"], [], [], ["aa"]]
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(X.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [1 / 3, 1.0, 0.0]


def test_headings(spark):
    assert one(spark, ["第一章 總則", "壹、公司簡介", "一、概況", "（一）沿革", "1.2 產品", "3. 其他", "(4) 項", "內文", None], X.numbering_level) == [1, 1, 2, 3, 5, 4, 5, None, None]


def test_refusals_and_furniture(spark):
    assert one(spark, ["文件中沒有相關資料", "Cannot answer", "12元", ""], X.is_refusal) == [True, True, False, False]
    assert one(spark, [" 第 12 頁  / 30 ", None], X.furniture_key) == ["第 # 頁 / #", None]


def test_keys(spark):
    assert one(spark, ["０４８４", "TW0484", "0484-TW", " 484", "0484 ", "abc", None, ""], keys.company_code) == ["0484"] * 5 + [None] * 3
    assert one(spark, ["0484_fy2016_fsa1.PDF", "０４８４－ＦＹ２０２３－ＦＳ", "0761 - FY2017 - AR", "484-FY2017-AR", "x", "", None], keys.filing_id) == ["0484-FY2016-FSA1", "0484-FY2023-FS", "0761-FY2017-AR", "0484-FY2017-AR", "X", None, None]
    assert one(spark, ["0484-FY2016-FS", "X", None], keys.filing_company) == ["0484", None, None]


def test_wilson_and_mcnemar(spark):
    df = spark.createDataFrame([(17.0, 33.0), (0.0, 0.0), (5.0, 5.0)], "k double, n double")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = df.select(lo.alias("a"), hi.alias("b")).collect()
    p, z, n = 17 / 33, 1.959963984540054, 33
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    assert got[0].a == pytest.approx((mid - half) / (1 + z * z / n)) and got[0].b == pytest.approx((mid + half) / (1 + z * z / n)) and got[1].a is None and got[2].b == 1.0
    pairs = [(3, 1, 0.625), (2, 1, 1.0), (5, 0, 0.0625), (6, 0, 0.03125), (4, 1, 0.375), (0, 0, 1.0), (40, 90, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a long, b long")
    got = [r.p for r in df.select("i", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).orderBy("i").collect()]
    want = [p if p is not None else 2 * sum(math.comb(130, k) for k in range(41)) / 2**130 for *_, p in pairs]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("t,want", [("千元", ("money", 1000, "TWD")), ("NT$'000", ("money", 1000, "TWD")), ("US$ thousand", ("money", 1000, "USD")), ("thousands of US dollars", ("money", 1000, "USD")), ("million shares", ("shares", 10**6, None)), ("（百萬元）", ("money", 10**6, "TWD")), ("億", (None, 10**8, None)), ("％", ("ratio", 1, None)), ("NT$bn", ("money", 10**9, "TWD")), ("", None), (None, None), ("未知", None), ("千　元", ("money", 1000, "TWD"))])
def test_units(t, want):
    assert parse_unit(t) == want


def test_notes_and_records():
    assert parse_note("單位：千元，惟股數為仟股")[0].scale == 1000 and parse_note("單位：千元，惟股數為仟股")[1]["shares"].kind == "shares"
    assert parse_note("In millions of US dollars, except per share amounts in dollars")[0] == ("money", 10**6, "USD")
    assert parse_note("含一次性利益 12 百萬元") == (None, {}) == parse_note(None)
    assert parse_account("權益總額(千元)", "balance")[:2] == ("權益總額", "money") and parse_account("基本每股盈餘", "income")[1] == "per_share"
    assert recorded("庫藏股數", "balance", "千元", "除股數以百萬股計外，以千元列示")[2:] == (10**6, None, "exception")
    assert recorded("營業收入", "income", None, "本表係以億元列示")[2:] == (10**8, "TWD", "note")
    assert recorded("營業收入(元)", "income", " ", "unaudited")[2:] == (1, "TWD", "label")
    assert recorded("營業收入", "income", "怪", "單位：千元")[4] == "unreadable" and recorded("營業收入", "income", None, None)[4] is None
    assert recorded("營業收入", "income", "千股", None)[4] == "other_kind"
