"""From questions to answers on literal rows: figures, dispatch, scope, readers, capabilities."""

from pyspark.sql import functions as F

from factlode.functions import fields as R
from factlode.operators import answering as A, capability as K, gates, geometry as G, scope

FACT = "line_id long, company_code string, period string, statement string, basis string, account string, source_kind string, source_ref string, value decimal(38,6), unit string, currency string, unit_is_uniform boolean, loaded_at timestamp, extra string"


def fact(i, period, account, value, unit="千元", ref="a", currency="TWD", uniform=True):
    from datetime import datetime
    from decimal import Decimal

    return (i, "0001", period, "income", "consolidated", account, "xbrl", ref, None if value is None else Decimal(value), unit, currency, uniform, datetime(2026, 1, 1, 0, 0, i % 60), "x")


def test_numeric_answers_and_refusals(spark):
    facts = spark.createDataFrame(
        [fact(1, "FY2022", "營收", 80), fact(2, "FY2023", "營業收入", 100), fact(3, "FY2023", "營業收入", 120), fact(4, "FY2023", "營業成本", 60), fact(5, "FY2023", "資產總額", 1), fact(6, "FY2023", "資產總計", 2, ref="b"), fact(7, "FY2023", "保留盈餘", 5, unit="百萬元"), fact(8, "FY2022", "保留盈餘", 0), fact(9, "FY2021", "保留盈餘", None), fact(10, "FY2023", "沒有的科目", 3)], FACT
    )
    asked = {
        "lookup": "甲公司民國112年度營業收入是多少", "growth": "甲公司2023年營業收入較前一年成長率", "delta": "甲公司2023年營業收入較前期增減多少", "ratio": "2023年營業成本佔營業收入比率", "ambiguous": "2023年資產總計是多少", "none": "2019年營業收入是多少", "unparsed": "2023年盈餘", "scale": "2023年保留盈餘成長率", "null": "2021年保留盈餘是多少", "empty": None,
    }
    q = spark.createDataFrame([(k, "0001", t, None, 1) for k, t in asked.items()] + [("nobody", None, asked["lookup"], None, 1)], "question_id string, company_code string, question string, statement_basis string, value int")
    got = {r.question_id: r for r in A.answer_numerically(q, facts).collect()}
    assert {k: r.status for k, r in got.items()} == {"lookup": "OK", "growth": "OK", "delta": "OK", "ratio": "OK", "ambiguous": "ambiguous", "none": "no_figure", "unparsed": "unparsed", "scale": "scale", "null": "no_value", "empty": "unparsed", "nobody": "unparsed"}
    assert (got["lookup"].answer, got["lookup"].unit, got["growth"].answer, got["delta"].answer, got["ratio"].answer, got["none"].answer) == ("120", "千元", "50", "40", "50", A.REFUSED)
    assert got["ratio"].operands == "營業成本 FY2023=60.000000; 營業收入 FY2023=120.000000" and got["ratio"].source_refs.count("xbrl:a") == 2 and got["none"].operands is None
    assert A.answer_numerically(q, facts.limit(0)).where("status = 'OK'").count() == 0 and A.answer_numerically(q.limit(0), facts).count() == 0


def test_dispatch_and_ladder(spark):
    rows = [("fig", "numeric", "5", "元", "FY2023", None, None, "答案：9\n單位：元\n期間：無"), ("chart", "chart", None, None, None, "35.2", "%", "答案：9"), ("miss", "numeric", None, None, None, None, None, "答案：9"), ("text", "narrative", None, None, None, None, None, "答案：因為缺料\n期間：FY2022"), ("silent", "narrative", None, None, None, None, None, None)]
    q = spark.createDataFrame(rows, "question_id string, route string, figure string, figure_unit string, figure_period string, chart_value string, chart_unit string, reply string")
    on = {r.question_id: (r.said, r.said_unit, r.said_period, r.handled_route) for r in A.dispatch(q, F.lit(True)).collect()}
    assert on == {"fig": ("5", "元", "FY2023", "numeric"), "chart": ("35.2", "%", None, "chart"), "miss": (A.REFUSED, None, None, "numeric"), "text": ("因為缺料", None, "FY2022", "narrative"), "silent": ("", None, None, "narrative")}
    off = {r.question_id: (r.said, r.handled_route) for r in A.dispatch(q, F.lit(False)).collect()}
    assert off["miss"] == ("9", "narrative")
    met = spark.createDataFrame([("fig", "rerank", True), ("miss", "rerank", False)], "query string, mode string, met boolean")
    steps = {(r.question_id, r.factor): r for r in A.climb(q, met).collect()}
    assert len(steps) == 40 and steps["fig", "F3"].said == "9" and steps["fig", "F4"].said == "5" and steps["chart", "F5"].said == "9" and steps["chart", "F6"].said == "35.2"
    assert steps["miss", "F7"].refused and steps["miss", "F7"].route == "unanswerable" and steps["miss", "F7"].cited_ok is None and steps["miss", "F6"].cited_ok is False and steps["fig", "F0"].cited_ok is None
    graded = spark.createDataFrame([("F0", True, "unanswerable", "narrative", "narrative", "narrative", False, True, True), ("F0", False, "unanswerable", "unanswerable", "unanswerable", "numeric", True, True, None)], "factor string, answerable boolean, category string, gold_route string, route string, handled_route string, refused boolean, correct boolean, cited_ok boolean")
    s = {r.measure: (r.n, r.k, r.rate) for r in A.summary(graded, ["factor"]).collect()}
    assert s == {"accuracy": (2, 2, 1.0), "citation": (1, 1, 1.0), "numeric_route": (0, 0, None), "route": (2, 2, 1.0), "over_answer": (2, 1, 0.5), "refusal_precision": (1, 1, 1.0)}


def test_scope(spark):
    names = spark.createDataFrame([("0001", "甲公司"), ("0001", "甲"), ("0002", "乙電子"), ("0003", "乙電子"), (None, "丙"), ("0004", None)], "code string, name string")
    q = spark.createDataFrame([("a", "甲公司與0004之比較"), ("b", "乙電子"), ("c", "10004元"), ("d", None), ("e", ""), (None, "甲")], "question_id string, question string")
    got = {r.question_id: r.codes for r in scope.company_scope(q, names).collect()}
    assert got == {"a": ["0001", "0004"], "b": ["0002", "0003"], "c": None, "d": None, "e": None}
    hits = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("c", "d2"), ("b", "d1")], "question_id string, doc_id string")
    docs = spark.createDataFrame([("d1", "0001"), ("d2", "0009")], "doc_id string, code string")
    s = scope.company_scope(q, names)
    assert sorted(map(tuple, scope.within_scope(hits, s, docs, "question_id").collect())) == [("a", "d1"), ("c", "d2")]


def test_readers(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert tuple(one(R.chart_reply, "數值： 35.2 \n單位：%\n依據：標籤")) == ("35.2", "%", "標籤")
    assert tuple(one(R.chart_reply, "數值：看不出來\n單位：無")) == (None, None, "") and one(R.chart_reply, "約 35").value is None
    assert [one(R.heading_period, t) for t in ("民國112年度", "112年 12月31日", "111年度及112年度", "金額", None)] == ["FY2023", "FY2023", None, None, None]
    assert [one(R.cjk_number, t) for t in ("一一二", "〇5", "十二", "", None)] == [112, 5, None, None, None]
    assert [one(R.longest_figure, t) for t in ("12 與 1,234.5 及 99", "無", None)] == ["1,234.5", None, None]
    assert [tuple(x) for x in one(R.year_values, "112年營收 1,234，111年為 -5.5")] == [("112", "1,234"), ("111", "-5.5")]
    assert [one(R.plain_path, t) for t in ("a/b.json", "/a", "a/../b", "a\\b", "C:x", "a//b", "a/", "", None)] == [True] + [False] * 8
    assert tuple(one(R.proportion, '{"n": 4, "correct": 3}')) == (4, 3, None)
    assert [one(R.proportion, t).problem for t in (None, "[1]", '{"rate": 0.5}', '{"n": 3}', '{"n": "x", "valid": 1}', '{"n": 1, "valid": 2}')] == ["missing", "not_an_object", "rate_without_count", "no_count", "not_a_number", "out_of_range"]
    assert spark.range(1).select(R.stable_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("j"), R.now_utc().alias("t")).first().j == '{"a":"2","b":"1"}'
    assert [one(R.statement_of, t) for t in ("營業收入", " 存貨 ", "別的", None)] == ["income", "balance", None, None]


def test_capability_pairs_and_overlaps(spark):
    c = spark.createDataFrame([("a", "usable", 10, 3, 5, 2), ("b", "too_short", 99, 99, 99, 99), ("c", None, 9, 3, 4, 1)], "doc_id string, verdict string, legible_pages int, tables int, tables_with_unit int, labelled_charts int")
    got = {r.doc_id: r.sources for r in K.capability(c).collect()}
    assert got["b"] == [] and got["c"] == ["table_cell"] and len(got["a"]) == 7 and got["a"] == sorted(got["a"])
    assert {r.question_type: r.documents for r in K.coverage(K.capability(c)).collect()}["table_cell"] == 2
    o = spark.createDataFrame([(f"q{i}", s, ok) for i in range(8) for s, ok in (("x", True), ("y", False), ("z", i < 4))], "q string, s string, ok boolean")
    p = {(r.left, r.right): (r.n, r.only_left, r.only_right, r.p, r.significant) for r in gates.pairwise_tests(o, "q", "s", "ok").collect()}
    assert p["x", "y"] == (8, 8, 0, 0.0078125, True) and p["x", "z"] == (8, 4, 0, 0.125, False) and len(p) == 3
    b = spark.createDataFrame([("d", 1, "k1", (0.0, 0.0, 10.0, 10.0)), ("d", 1, "k2", (0.0, 0.0, 10.0, 5.0)), ("d", 1, "k3", (50.0, 50.0, 50.0, 60.0)), ("d", 2, "k4", (0.0, 0.0, 10.0, 10.0))], "doc_id string, page int, k string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert [(r.k_1, r.k_2, r.overlap, r.iou) for r in G.overlapping(b, "k").collect()] == [("k1", "k2", 1.0, 0.5)]
