"""Manifests, reports, forms, catalogues, loads and places on literal rows."""

import pytest
from pyspark.sql import functions as F, types as T

from factlode.operators import geometry as G, scoring, tables as Tb
from factlode.sources import files, manifests as M


def test_manifest_round_trip(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("t", T.StringType())])
    rows = [("b", 2, 'a "quoted": #x'), ("a", None, "列\n二"), ("c", 3, None), ("d", 4, "")]
    df = spark.createDataFrame(rows, schema)
    text = M.manifest_lines(df, "k", "two\nlines")
    value = text.first().value
    assert value.startswith("# two\n# lines\n- k: ") and value.index('"a"') < value.index('"b"')
    assert sorted(map(tuple, M.read_manifest(text, schema).collect())) == sorted(rows)
    assert M.read_manifest(spark.createDataFrame([("# nothing\n",), (None,)], "value string"), schema).count() == 0


def test_reports_and_provenance(spark):
    r = spark.createDataFrame([("b", 4, 1, 0.25), ("a", 0, 0, None)], "name string, n long, k long, rate double")
    assert [x.line for x in M.markdown_report(r, "small sample", "f" * 64).orderBy("place").collect()] == ["small sample", "lock: " + "f" * 64, "| name | k / n | % |", "|-|-|-|", "| a | 0 / 0 | — |", "| b | 1 / 4 | 25.00 |"]
    for bad in ((r, " ", "f" * 64), (r, "x", "short"), (spark.createDataFrame([("a", 0, 0, 1.0)], r.schema), "x", "f" * 64)):
        with pytest.raises(ValueError):
            M.markdown_report(*bad)
    p = M.provenance(spark.createDataFrame([("a",), ("z",)], "k string"), spark.createDataFrame([("a", 1)], "k string, pages int"), "k", ["pages"])
    assert sorted(map(tuple, p.collect())) == [("a", "1"), ("z", "—")]


def test_forms(spark):
    lines = ["noise", "Q: lost", "ID x1", "Q: what ", "A: 5", "A: 6", "UNIT:", "ID x2", "CURRENCY: TWD"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)] + [("g", 0, None)], "file string, n int, line string")
    assert sorted(map(tuple, M.parse_forms(df).collect())) == [("f", "x1", "what", "6", None, None), ("f", "x2", None, None, None, "TWD")]


def test_endpoints(spark):
    rows = spark.createDataFrame([({"年度": "112", "季別": "1", "a": "x"},), ({"年度": "112", "季別": "1"},), ({"b": "x"},)], "row map<string,string>")
    assert sorted(map(str, M.endpoint_profile(rows).collect())) == sorted(["Row(year='112', quarter='1', n=2, columns=3)", "Row(year=None, quarter=None, n=1, columns=1)"])
    assert M.endpoint_catalogue(spark.createDataFrame([("{}",), (None,), ("no json",)], "value string"), ["x"]).count() == 0


def test_rename_plan(spark):
    f = spark.createDataFrame([("a", "0001-FY2020-x.pdf", "0001", 2020, "x", "OK"), ("b", "n", "0002", 2020, "x", "OK"), ("c", "n", "0002", 2020, "x", "OK"), ("d", "n", None, None, None, "UNKNOWN"), ("e", "n", "0003", 2020, "x", "OK")], "doc_id string, name string, code string, fiscal_year int, doc_type string, status string")
    assert {r.doc_id: r.action for r in files.rename_plan(f).collect()} == {"a": "keep", "b": "conflict", "c": "conflict", "d": "unidentified", "e": "rename"}


def test_loads(spark):
    text = "民國112年度 111年度\n營業收入(淨額) 1,234 2,345\n3,456 4,567\n奇怪科目 1,000 2,000\n存貨 1,111 2,222 3,333"
    pages = spark.createDataFrame([("d", 1, "單位：千元\n" + text), ("e", 1, text)], "doc_id string, page int, text string")
    got = Tb.load_rows(Tb.page_rows(pages), Tb.page_units(pages))
    count = {(r.doc_id, r.reason): r["count"] for r in got.groupBy("doc_id", "reason").count().collect()}
    # figures without a name go on with the row before, which is as two rows then
    assert count == {("d", None): 4, ("d", "unlabelled"): 2, ("d", "unknown_account"): 2, ("d", "no_period"): 1, ("e", "no_unit"): 4, ("e", "unlabelled"): 2, ("e", "unknown_account"): 2, ("e", "no_period"): 1}
    fact = got.where("reason is null and figure = '1,234'").first()
    assert (fact.account, fact.statement, fact.period, fact.unit) == ("營業收入", "income", "FY2023", "千元")


def test_corroboration(spark):
    answers = spark.createDataFrame([("a", "1,234"), ("b", "庫存去化"), ("c", "9,876 與 1,234"), ("d", "5,555"), ("e", "？"), ("f", None)], "query string, answer string")
    cited = spark.createDataFrame([(q, "x", 1) for q in "abcdef"], "query string, doc string, page int")
    pages = spark.createDataFrame([("x", 1, "為 1234 千元"), ("x", 2, "庫 存去化"), ("y", 1, "5,555"), ("x", 3, None)], "doc string, page int, text string")
    assert {r.query: (r.verdict, r.pages) for r in scoring.corroborate(answers, cited, pages).collect()} == {"a": ("cited", 1), "b": ("elsewhere", 1), "c": ("partial", 0), "d": ("absent", 0), "e": ("unverifiable", 0)}


def test_words_rows_and_pages(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    b = spark.createDataFrame([("t", "d", 1, (0.0, 100.0, 100.0, 200.0)), ("u", "d", 2, (0.0, 0.0, 9.0, 9.0))], f"ord string, doc_id string, page int, bbox {box}")
    w = spark.createDataFrame([("d", 1, "in", (-0.5, 100.0, 5.0, 110.0)), ("d", 1, "out", (-2.0, 100.0, 5.0, 110.0)), ("d", 1, "beside", (200.0, 140.0, 210.0, 160.0))], f"doc_id string, page int, text string, bbox {box}")
    assert [tuple(r) for r in G.words_in(w, b, "ord").collect()] == [("t", "d", 1, "in")]
    assert [r.text for r in G.same_row(b, w, "ord").collect()] == ["beside"]
    blocks = spark.createDataFrame([("covered", "d", 1, (0.0, 100.0, 50.0, 150.0)), ("above", "d", 1, (0.0, 0.0, 50.0, 50.0)), ("flat", "d", 1, (0.0, 300.0, 50.0, 300.0))], f"ord string, doc_id string, page int, bbox {box}")
    assert [(r.ord, r.place) for r in G.assemble(blocks, b).where("page = 1").orderBy("place").collect()] == [("above", 1), ("t", 2), ("flat", 3)]
