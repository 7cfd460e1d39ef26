"""Small surveyed operators: pooled gain, refusal rates, falling series, correctness to the letter, texts of figures, page offsets."""

from decimal import Decimal

from pyspark.sql import functions as F

from factlode.operators import gates, pages, scoring


def test_pooled_gain_weighs_items(spark):
    rows = [(s, c, i < k) for s, c, k, n in (("F0", "a", 1, 3), ("F0", "b", 0, 1), ("F7", "a", 2, 3), ("F7", "b", 1, 1), ("F7", "c", 0, 9), ("F0", "c", 9, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "system string, category string, correct boolean")
    gain = lambda cs: gates.pooled_gain(df, "system", "category", cs, "correct", "F0", "F7").first().gain
    assert gain(["a", "b"]) == 50.0 and gain(["a", "none"]) is None


def test_refusal_rates(spark):
    df = spark.createDataFrame([(True, True), (True, False), (True, False), (False, True), (False, False)], "refused boolean, should_refuse boolean")
    assert tuple(gates.refusal_rates(df).first()) == (3, 2, 1, 0.3333, 0.5)
    assert tuple(gates.refusal_rates(df.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)


def test_falls(spark):
    df = spark.createDataFrame([("x", 1, 3), ("x", 10, 4), ("x", 5, 5), ("y", 1, 2), ("y", 5, 2)], "mode string, k int, correct int")
    assert [tuple(r) for r in gates.falls(df, ["mode"], "k", "correct").collect()] == [("x", 5, 10, 5, 4)]


def test_protocol_correct(spark):
    rows = [(True, True, None, False, 0.0), (True, False, None, True, 1.0), (False, True, True, True, 1.0), (False, False, False, True, 1.0), (False, False, True, False, 0.0), (False, False, None, False, 0.8), (False, False, None, False, 0.79), (False, False, None, True, None), (False, False, None, False, None)]
    df = spark.createDataFrame(rows, "should_refuse boolean, refused boolean, numeric boolean, exact boolean, f1 double")
    assert [r.c for r in df.select(scoring.protocol_correct().alias("c")).collect()] == [True, False, False, False, True, True, False, True, False]


def test_figure_texts(spark):
    given = ["1234567", "1234.5", "0.125", "-9876.555", "1000.001", "0", "100", None]
    df = spark.createDataFrame([(None if g is None else Decimal(g),) for g in given], "v decimal(38, 6)")
    rows = df.select(scoring.figure_text(F.col("v")).alias("a"), scoring.amount_text(F.col("v")).alias("b")).collect()
    for g, r in zip(given[:-1], rows):
        v = Decimal(g)
        assert r.a == f"{v.quantize(Decimal('0.01')) if v % 1 else v.quantize(Decimal('1')):,}" and r.b == f"{v:,.2f}".rstrip("0").rstrip("."), g
    assert rows[-1].a is None and rows[-1].b == "無法回答"


def test_page_offsets(spark):
    texts = {1: "甲乙", 2: "", 3: "丙", 5: None, 7: "丁戊己"}
    got = {r.page: (r.start, r.end) for r in pages.page_offsets(spark.createDataFrame([("d", p, t) for p, t in texts.items()], "doc_id string, page int, text string")).collect()}
    whole = "\n".join(t for t in texts.values() if t)
    assert set(got) == {1, 3, 7} and all(whole[a:b] == texts[p] for p, (a, b) in got.items())
