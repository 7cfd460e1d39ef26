"""Operators on literal rows: refusals, ties, nulls, empties, repeats."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlode.operators import answers as A, chunking, dense, facts, fusion, gates, geometry as G, layout, lexical, pages, questions as Q, scoring, tables as T, unit_hmm, validate as V
from factlode.operators.prefix import running_sums
from factlode.operators.similarity import similar_texts
from factlode.operators.unit_hmm import SCALES, common_units, decode_units, viterbi


@pytest.mark.parametrize("hot", [10**6, 7])
def test_running_sums(spark, hot):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5, 1.5, 2.5, 9.0, -1.0]), i, rng.choice([1, 2, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, i int, range int")
    got = {(r.i): (r.upto, r.n) for r in running_sums(df.withColumn("one", F.lit(1)), ["g"], ["x", "i"], {"upto": "range", "n": "one"}, hot, 4).collect()}
    for g, x, i, _ in rows:
        before = [r for r in rows if r[0] == g and (r[1], r[2]) <= (x, i)]
        assert got[i] == (sum(r[3] or 0 for r in before), len(before))
    assert running_sums(df.limit(0), ["g"], ["x", "i"], {"s": "range"}, hot).count() == 0


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "毛利率 上升 毛利"), ("d2", "毛利率"), ("d3", "負債"), ("d4", None), ("d2", "毛利率"), (None, "毛利")], "id string, t string")
    q = spark.createDataFrame([("q1", "毛利率"), ("q2", "沒有這個"), ("q3", None)], "id string, t string")
    got = lexical.bm25_search(docs, q, "id", "t", "id", "t", 5).orderBy("query", "rank").collect()
    assert [(r.query, r.doc, r.rank) for r in got] == [("q1", "d2", 1), ("q1", "d1", 2)]
    with pytest.raises(ValueError):
        lexical.bm25_search(docs, q, "id", "t", "id", "t", 0)
    assert lexical.bm25_search(docs.limit(0), q, "id", "t", "id", "t").count() == 0


@pytest.mark.parametrize("block", [20_000, 2])
def test_dense(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "ROW_BLOCK", 25)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, [float("nan")] * 8), (104, v[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r["rank"]): r.doc for r in dense.dense_search(df, df.where("id < 5 or id > 99"), "id", "v", 4, block).collect()}
    u = np.vstack([v, v[3]])
    ids = [*range(60), 104]
    u = u / np.linalg.norm(u, axis=1)[:, None]
    for q in (0, 1, 2, 3, 4):
        order = sorted(zip(-np.round(u @ u[q], 6), ids))[:4]
        assert [got[q, k + 1] for k in range(4)] == [d for _, d in order]
    assert (103, 1) not in got and dense.dense_search(df.limit(0), df, "id", "v").count() == 0 and dense.dense_search(df, df.where("id < 0"), "id", "v").count() == 0


def test_fusion(spark):
    rows = [("q", "a", "x", 1), ("q", "b", "x", 2), ("q", "a", "x", 3), ("q", "c", "x", 4), ("q", "c", "y", 1), (None, "a", "x", 1), ("q", None, "x", 1)]
    got = fusion.fuse(spark.createDataFrame(rows, "q string, i string, s string, p int"), "q", "i", "s", "p").orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [("c", round(1 / 63 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("b", round(1 / 62, 9))]


def test_metrics_and_budget(spark):
    hits = spark.createDataFrame([("q", 1, "d", [1]), ("q", 2, "d", [2, 3]), ("q", 9, "e", [1])], "query string, rank int, doc string, pages array<int>")
    t = spark.createDataFrame([("q", "d", 3), ("q", "e", 1), ("z", "d", 1)], "query string, doc string, page int")
    got = {r["query"]: r for r in fusion.retrieval_metrics(hits, t).collect()}
    assert (got["q"].recall, got["q"].reciprocal_rank, got["q"].covered, got["q"].complete, got["q"].crosses_pages) == (True, 0.5, 1, False, False)
    assert (got["z"].recall, got["z"].reciprocal_rank, got["z"].crosses_pages) == (False, 0.0, None)
    b = spark.createDataFrame([("q", 1, 60), ("q", 2, 60), ("q", 3, 60)], "query string, rank int, chars int")
    assert fusion.within_budget(b, 100).count() == 2


def test_similar_texts_lose_no_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("甲乙丙丁戊己") for _ in range(14)) for _ in range(25)]
    texts = base + [t[:7] + "庚" + t[8:] for t in base] + [t + "辛" for t in base] + [base[0], base[0], "", None, "a", "A "]
    pairs, members = similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 0.6)
    grams = {i: frozenset(t[k : k + 2] for k in range(len(t) - 1)) if len(t) > 1 else frozenset([t]) for i, t in enumerate((x or "").replace(" ", "").lower() for x in texts) if t}
    cls = {r.id: r["class"] for r in members.collect()}
    assert set(cls) == set(grams) and all(cls[i] == min(j for j in grams if grams[j] == grams[i]) for i in grams)
    reps = sorted(set(cls.values()))
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.6}
    assert {(r.class_1, r.class_2) for r in pairs.collect()} == want and want


FACT = "line_id long, company_code string, period string, statement string, basis string, account string, value decimal(38,6), unit string, currency string, unit_is_uniform boolean, unit_note string, source_kind string, source_ref string, loaded_at timestamp"


def fact(i, period, value, unit="千元", account="營業收入", currency="TWD", uniform=True, note=None, code="0001"):
    from datetime import datetime
    from decimal import Decimal

    return (i, code, period, "income", "c", account, None if value is None else Decimal(str(value)), unit, currency, uniform, note, "x", f"r{i}", datetime(2024, 1, 1))


def test_templates(spark):
    rows = [fact(1, "FY2022", 100), fact(2, "FY2023", 150), fact(3, "FY2021", 0), fact(4, "FY2020", None), fact(5, "FY2024", 1, unit="元"), fact(6, "FY2025", 2, unit=None), fact(7, "FY2026", 3, unit=None), fact(8, "FY2022", 30, account="淨利"), fact(9, "FY2023", 1, account="淨利"), fact(10, "FY2023", 2, account="淨利")]
    f = spark.createDataFrame(rows, FACT)
    ch = {r.period: r for r in facts.year_changes(f).collect()}
    assert (ch["FY2023"].status, float(ch["FY2023"].delta), float(ch["FY2023"].growth)) == ("OK", 50, 50)
    assert [ch[p].status for p in ("FY2022", "FY2021", "FY2024", "FY2025", "FY2026")] == ["zero_base", "no_value", "scale", "no_unit", "no_unit"]
    r = {x.period: x for x in facts.account_ratios(f, "淨利", "營業收入").collect()}
    assert (r["FY2022"].status, float(r["FY2022"].ratio)) == ("OK", 30) and "FY2023" not in r
    want = spark.createDataFrame([("0001", "營業收入", "FY2022", "c"), ("0001", "淨利", "FY2023", "c"), ("0001", "淨利", "FY2030", "c"), ("0001", "無此", "FY2022", "c"), ("9", "淨利", "FY2022", "c")], "company_code string, account string, period string, basis string")
    got = {(x.company_code, x.account, x.period): x.status for x in facts.exactly_one(f, want, spark.createDataFrame([("0001",)], "code string")).collect()}
    assert list(got[k] for k in (("0001", "營業收入", "FY2022"), ("0001", "淨利", "FY2023"), ("0001", "淨利", "FY2030"), ("0001", "無此", "FY2022"), ("9", "淨利", "FY2022"))) == ["OK", "AMBIGUOUS", "NO_PERIOD", "NO_ACCOUNT", "NO_COMPANY"]
    assert {x.period: x.verdict for x in facts.cross_source(f.where("account = '淨利'")).collect()} == {"FY2022": "MISS", "FY2023": "DISAGREE"}
    assert facts.last_wins(f.select("account", "value", "line_id"), ["account"], ["line_id"]).count() == 2
    assert facts.year_changes(f.limit(0)).count() == 0


def path_cost(model, cost, stated, same, path):
    total = model.start[0, path[0]] if stated[0] < 0 else 0.0
    for i, k in enumerate(path):
        total += cost[i, k] + (model.move[0, int(same[i]), path[i - 1], k] if i else 0.0)
    return total


def test_viterbi_finds_a_least_path():
    rng = np.random.default_rng(2)
    k = len(SCALES)
    model = unit_hmm.Model(rng.random((4, k)) * 3, rng.random((4, 2, k, k)) * 4, rng.random((4, k, 4)), np.full(4, 8.0), np.full(4, 1.0), {})
    for _ in range(60):
        n = int(rng.integers(1, 6))
        level = rng.choice([3.0, 6.1, 9.2, 4.4, np.nan], n)
        stated = np.where(rng.random(n) < 0.4, rng.integers(0, k, n), -1)
        kind, same = np.zeros(n, np.int64), rng.random(n) < 0.3
        cost = unit_hmm.emissions(model, level, np.zeros(n, np.int64), kind, np.full(n, 8.0), stated)
        got = viterbi(model, cost, stated, np.zeros(n, np.int64), kind, same)
        assert ((got == stated) | (stated < 0)).all()
        best = min(path_cost(model, cost, stated, same, p) for p in itertools.product(*[range(k) if s < 0 else [s] for s in stated]))
        assert abs(path_cost(model, cost, stated, same, got) - best) < 1e-9
        # the cheapest passage ends where the path does, if nothing follows
        assert stated[-1] >= 0 or unit_hmm.passage(model, cost, stated, 0, same, True).min(0).argmin() == got[-1]
    assert len(viterbi(model, np.zeros((0, k)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))) == 0


def test_blocks_of_a_hot_series_give_its_path(spark, data_dir, monkeypatch):
    f = spark.read.parquet(f"{data_dir}/fin_line_item.parquet").withColumn("company_code", F.lit("1")).where("account in ('營業收入', '保留盈餘', '存貨淨額')")
    f = f.withColumns({"unit": F.when(F.col("line_id") % 5 == 0, F.col("unit")), "unit_note": F.lit(None).cast("string")})
    kept, fit = [], unit_hmm.fit
    monkeypatch.setattr(unit_hmm, "fit", lambda *x: kept[0] if kept else kept.append(fit(*x)) or kept[0])
    whole, cut = (sorted((r.line_id, r.decoded) for r in decode_units(f, hot_rows=h, block=18).collect()) for h in (10**6, 20))
    assert whole == cut and len({d for _, d in whole}) > 1


def test_hidden_units_are_found_again(spark, data_dir):
    f = spark.read.parquet(f"{data_dir}/fin_line_item.parquet").where("value <> 0")
    known = decode_units(f).where("scale is not null and kind in ('money', 'shares')").select("line_id", F.col("scale").alias("true"))
    hide = F.pmod(F.xxhash64("line_id"), F.lit(10)) == 0
    masked = f.withColumns({c: F.when(~hide, F.col(c)) for c in ("unit", "unit_note")})
    got = decode_units(masked).where("scale is null").join(known, "line_id").agg(F.count("*").alias("n"), F.avg((F.col("decoded") == F.col("true")).cast("int")).alias("right"), F.avg((F.col("true") == 1000).cast("int")).alias("usual")).first()
    assert got.n > 50 and got.right > max(0.85, got.usual + 0.15)


@pytest.mark.parametrize("hot", [10**6, 10])
def test_units_decode(spark, hot):
    rows = [fact(i, f"FY{2000 + i}", 5000 + i, unit="千元" if i % 3 == 0 else None) for i in range(30)] + [fact(40, "FY2001", 5.0, unit=None), fact(41, "FY2005", None), fact(42, "FY2006", 0, unit=None), fact(43, "FY2006", 7, account="毛利率", unit="%"), fact(44, "FY2006", 9, account="庫藏股數(千股)", unit=None), fact(45, "FY2006", 9, unit="怪"), fact(1, "FY2001", 5001, unit=None)]
    f = spark.createDataFrame(rows, FACT)
    d = decode_units(f, hot_rows=hot, block=3).collect()
    assert sorted(r.line_id for r in d) == sorted(r[0] for r in rows)
    assert all(r.decoded == 1000 for r in d if r.line_id < 30)
    c = {r.line_id: r for r in common_units(f, hot_rows=hot, block=3).collect()}
    assert float(c[0].common_value) == 5_000_000 and c[0].common_unit == "元" and c[0].reason is None
    assert [c[i].reason for i in (40, 41, 43, 44, 45)] == ["no_unit", "no_value", "not_a_quantity", None, "unreadable_unit"] and float(c[44].common_value) == 9000 and c[44].common_unit == "股"
    assert decode_units(f.limit(0)).count() == 0


def test_pages(spark):
    p = spark.createDataFrame([("d", 1, "公司年報"), ("d", 2, "\x01é Ω Ж \ue000 ☃"), ("d", 5, ""), ("d", 9, None)], "doc_id string, page int, text string")
    got = {r.page: (r.characters, r.off_script, r.controls, r.private_use, r.other) for r in pages.page_defects(p).collect()}
    assert got == {1: (4, 0, 0, 0, 0), 2: (6, 1, 1, 1, 0), 5: (0, 0, 0, 0, 0), 9: (0, 0, 0, 0, 0)}
    assert [(r.first, r.last) for r in pages.silent_runs(p).collect()] == [(3, 9)]
    q = pages.document_quality(p).first()
    assert q.verdict == "too_short" and q.longest_silence == 7 and q.readable == 1
    v = pages.defect_verdicts(spark.createDataFrame([(100, 3, 0, 3, 0), (40, 40, 0, 0, 0), (100, 5, 0, 0, 0)], "characters int, off_script int, controls int, private_use int, other int")).collect()
    assert [(r.garbled, r.mode) for r in v] == [(True, "private_use"), (False, ""), (False, "")]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "字" * 1700), (2, ""), (3, None), (4, " " * 900 + "字"), (5, "短")], "id int, t string")
    got = [(r.id, r.chunk, r.start) for r in chunking.fixed_windows(d, "id", "t").orderBy("id", "chunk").collect()]
    assert got == [(1, 0, 0), (1, 1, 700), (1, 2, 1400), (4, 0, 700), (5, 0, 0)]
    b = [("d", 0, 1, "heading", "甲", ["甲"]), ("d", 1, 1, "paragraph", "字" * 700, ["甲"]), ("d", 2, 1, "paragraph", "字" * 700, ["甲"]), ("d", 3, 2, "table", "表", ["甲"]), ("d", 4, 2, "paragraph", "短", ["甲", "一"]), ("d", 5, 3, "paragraph", "短", ["甲", "二"]), ("d", 6, 3, "header_footer", "- 3 -", None)]
    out = chunking.section_chunks(spark.createDataFrame(b, "doc_id string, ord int, page int, kind string, text string, section_path array<string>")).orderBy("chunk").collect()
    assert [(r.section_path, r.pages, r.kinds) for r in out] == [(["甲"], [1], ["paragraph"]), (["甲"], [1], ["paragraph"]), (["甲"], [2], ["table"]), (["甲"], [2, 3], ["paragraph"])]


def test_row_reader(spark):
    page = "單位：新台幣仟元\n113年12月31日　112年12月31日\n現金及約當現金 1,234 2,345\n負債 \n(1,000)\n2,000\n其他 5,000 6,000 7,000 8,000\n6\n112年度\n收入 9.5"
    parts = "112年度 111年度\n9,999 8,888\n流動資產\n存貨 1,000 2,000\n3,000 4,000 5,000 6,000\n收入 7,000 8,000"
    pages_ = spark.createDataFrame([("d", 1, page, 0), ("d", 2, None, 0), ("d", 3, "", 0), ("e", 1, parts, 0), ("e", 2, "沒有表頭 1,000", 0)], "doc_id string, page int, text string, row int")
    t = T.table_rows(pages_).cache()
    got = {(r.doc_id, r.page, r.table, r.row): r for r in t.collect()}
    assert {k: r.width for k, r in got.items() if k[0] == "d"} == {("d", 1, 0, i): 2 for i in range(4)} | {("d", 1, 1, 0): 1} and got["d", 1, 0, 0].figures == ["1,234", "2,345"] and got["d", 1, 0, 1].figures == ["(1,000)", "2,000"]
    assert [(got["d", 1, 0, i].label, got["d", 1, 0, i].labelled) for i in (2, 3)] == [("其他", True), ("", False)]
    # figures before any name stand in a row of their own
    assert [(got["e", 1, 0, i].label, got["e", 1, 0, i].figures) for i in range(5)] == [("", ["9,999", "8,888"]), ("流動資產", []), ("存貨", ["1,000", "2,000"]), ("", ["3,000", "4,000"]), ("", ["5,000", "6,000"])]
    ask = [("a", "d", 1, "現金及約當現金", "112年12月31日"), ("b", "d", 1, "不存在的科目", "112年度"), ("c", "e", 1, "流動資產(淨額)", "111年度"), ("x", "e", 1, None, None), ("y", "none", 1, "存貨", "112年度")]
    cells = {r.key: (r.figure, r.route) for r in T.resolve_cells(t, spark.createDataFrame(ask, "key string, doc_id string, page int, account string, period string")).collect()}
    assert cells == {"a": ("2,345", "row"), "b": (None, "unresolved"), "c": ("6,000", "breakdown_total"), "x": (None, "unresolved"), "y": (None, "unresolved")}
    assert T.page_rows(pages_.limit(0)).count() == 0


def test_declared_units(spark):
    d = spark.createDataFrame([(1, "單位：新台幣仟元，惟每股盈餘為元"), (2, "除另予註明者外，金額為新台幣千元"), (3, "沒有"), (4, None)], "i int, t string")
    got = {r.i: r.u for r in d.select("i", T.declared_unit(F.col("t")).alias("u")).collect()}
    assert (got[1].unit, got[1].currency, got[1].exception, got[1].qualified) == ("千元", "新台幣", "每股盈餘為元", False)
    assert got[2].qualified and got[3].unit is None
    p = spark.createDataFrame([("d", 1, "x"), ("d", 2, "單位：千元"), ("d", 3, ""), ("d", 5, "單位：元"), ("e", 1, None)], "doc_id string, page int, text string")
    assert {(r.doc_id, r.page): (r.unit, r.note) for r in T.page_units(p).collect()} == {("d", 1): (None, None), ("d", 2): ("千元", None), ("d", 3): ("千元", "承第2頁之單位"), ("d", 5): ("元", None), ("e", 1): (None, None)}
    s = spark.createDataFrame([([["a", "1"], ["b", "(2)"]],), ([["a"]],)], "r array<array<string>>").select(*T.table_shape(F.col("r"))).collect()
    assert [x.is_table for x in s] == [True, False] and s[0].numeric_cells == 2


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_geometry(spark):
    b = lambda *x: dict(zip(("x0", "y0", "x1", "y1"), map(float, x)))
    blocks = spark.createDataFrame([("d", 1, 0, b(0, 0, 10, 10)), ("d", 1, 1, b(50, 50, 60, 60)), ("d", 2, 2, b(0, 0, 10, 10))], f"doc_id string, page int, ord int, bbox {BOX}")
    regions = spark.createDataFrame([("d", 1, b(0, 0, 10, 6))], f"doc_id string, page int, bbox {BOX}")
    assert sorted(r.ord for r in G.uncovered(blocks, regions).collect()) == [1, 2]
    caps = spark.createDataFrame([("d", 1, 0, b(0, 12, 9, 14), "圖一"), ("d", 1, 1, b(0, 30, 9, 34), "圖二"), ("d", 1, 2, b(200, 52, 210, 54), "遠")], f"doc_id string, page int, ord int, bbox {BOX}, text string")
    assert {r.ord: r.caption for r in G.nearest_caption(blocks, caps).collect()} == {0: "圖一", 1: None, 2: None}
    grown = G.cluster_boxes(blocks.unionByName(spark.createDataFrame([("d", 1, 9, b(20, 0, 30, 10))], blocks.schema))).where("page = 1").collect()
    assert sorted(r.paths for r in grown) == [1, 2]
    t = spark.createDataFrame([("d", 1, 0, b(0, 0, 10, 10), 2, 4), ("d", 1, 1, b(0, 0, 10, 9), 3, 4), ("d", 1, 2, b(20, 0, 30, 9), 1, 4)], f"doc_id string, page int, ord int, bbox {BOX}, numeric_cells int, cells int")
    assert sorted(r.ord for r in G.dedupe_tables(t).collect()) == [1, 2]
    c = spark.createDataFrame([("d", 1, 0, 3, 0.5, 0.9), ("d", 2, 0, 3, 0.1, 0.4), ("d", 3, 0, 3, 0.1, 0.4)], "doc_id string, page int, ord int, n_cols int, y0 double, y1 double")
    assert {r.page: r.continues_from_page for r in G.continuations(c).collect()} == {1: None, 2: 1, 3: None}
    assert [r.x for r in blocks.select(G.iou("bbox", "bbox").alias("x")).collect()] == [1.0] * 3


def test_layout(spark):
    line = lambda p, i, t, y, size=10.0, bold=False: ("d", p, i, t, 50.0, float(y), 200.0, float(y) + size, size, bold, 800.0)
    rows = [line(p, 0, f"年報 - {p} -", 5) for p in (1, 2, 3)] + [line(1, 1, "第一章 總則", 60, 18.0), line(1, 2, "內文一段很長的文字", 90), line(1, 3, "接續的文字", 102), line(1, 4, "另一段", 200), line(2, 1, "一、概況", 60, 14.0), line(2, 2, "內文", 90), line(3, 1, "第二章 其他", 60, 18.0), line(3, 2, "末段。", 90)]
    df = spark.createDataFrame(rows, "doc_id string, page int, i int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, height double")
    kinds = {(r.page, r.i): (r.kind, r.level) for r in layout.classify(df).collect()}
    assert kinds[1, 0] == ("header_footer", None) and kinds[1, 1] == ("heading", 1) and kinds[2, 1] == ("heading", 2) and kinds[1, 2][0] == "paragraph"
    out = layout.blocks(layout.classify(df)).orderBy("ord").collect()
    assert [(r.text, r.section_path) for r in out if r.kind == "paragraph"] == [("內文一段很長的文字 接續的文字", ["第一章 總則"]), ("另一段", ["第一章 總則"]), ("內文", ["第一章 總則", "一、概況"]), ("末段。", ["第二章 其他"])]


def test_questions(spark):
    d = spark.createDataFrame([("民國111年度與民國112年度營業收入分別是多少",), ("2023 年度（民國112年度）資產總計多少",), ("走勢圖最高點",), ("負債總額占資產總額的比率",), ("非流動資產佔資產總計多少",), ("碳排放強度（每百萬元營收）",), ("為什麼",), ("營業收入較前期增加多少",)], "q string")
    got = d.select(Q.route(F.col("q")).alias("r"), Q.accounts(F.col("q")).alias("a"), Q.numeric_kind(F.col("q")).alias("k")).collect()
    assert [r.r for r in got] == ["numeric", "chart", "chart", "numeric", "numeric", "chart", "narrative", "chart"]
    assert [r.a for r in got][3:6] == [["負債總計", "資產總計"], ["非流動資產", "資產總計"], []] and [r.k for r in got] == [None, "lookup", None, "ratio", "ratio", None, None, "delta"]


def test_scores(spark):
    schema = "question_id string, answer string, acceptable_variants array<string>, unit string, period string, tolerance struct<type:string,value:double>, answerable boolean, predicted string, predicted_unit string, predicted_period string"
    rows = [("a", "530,738,356", [], "千元", "FY2023", None, True, "530738356 千元", "仟元", "FY2023"), ("b", "1.2億", [], None, "民國112年度", ("relative", 0.005), True, "120,100,000", None, "2023年度"), ("c", None, None, None, "FY2023", None, False, "文件中沒有", None, None), ("d", "庫存去化", ["庫存 去化"], None, "FY2023", None, True, "無法回答", None, "FY2023"), ("e", "100", [], "%", "FY2023", ("absolute", 0.1), True, "100.05", "元", "FY2023"), ("f", "12、13", [], None, "FY2023", None, True, "12", None, "FY2023")]
    got = {r.question_id: r for r in scoring.score_answers(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k].correct for k in "abcdef"] == [True, True, True, False, False, False]
    assert got["e"].numeric and not got["e"].unit_ok and got["c"].numeric is None and got["f"].numeric is False and got["d"].refused
    s = spark.createDataFrame([("營業收入1,234仟元", "本期營業收入 1234 千元"), ("庫存去化", "無關"), ("", "x")], "c string, e string").select(scoring.supports(F.col("c"), F.col("e")).alias("x")).collect()
    assert [r.x for r in s][:2] == [True, False]
    f1 = spark.createDataFrame([("ab", "ab"), ("", ""), ("abc", "abd"), ("a", "")], "a string, b string").select(scoring.token_f1(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in f1] == [1.0, 1.0, 0.5, 0.0]


def test_gates(spark):
    good = {"data_reproducible": 1.0, "results_reproducible": 1.0, "pooled_gain": 15.0, "single_gain": 10.0, "regression": 5.0, "citation": 0.9, "numeric_route": 0.9, "route": 0.85, "over_answer": 0.25, "refusal_precision": 0.8, "probe_refusals": 4.0, "retrieval_p95": 3.0, "generation_p95": 60.0, "memory_gb": 22.0}
    run = lambda m: gates.decide(spark.createDataFrame(list(m.items()), "metric string, value double")).collect()
    assert all(r.passed for r in run(good)) and run(good)[0].decision == "GO"
    assert run({k: v for k, v in good.items() if k != "memory_gb"})[0].decision == "CONDITIONAL_GO"
    for k in set(good) - {"retrieval_p95", "generation_p95", "memory_gb"}:
        assert run({x: v for x, v in good.items() if x != k})[0].decision == "NO_GO"
    r = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "g string, ok boolean")
    p = {x.g: x for x in gates.proportions(r, ["g"], "ok", "ok is not null").collect()}
    assert (p["a"].n, p["a"].k, p["a"].rate) == (2, 1, 0.5) and p["b"].rate is None
    claimed = spark.createDataFrame([("a", 2, 1, 0.5), ("c", 1, 1, 1.0)], "g string, n long, k long, rate double")
    assert {(x.g, x.kind) for x in gates.verify(claimed, gates.proportions(r, ["g"], "ok", "ok is not null").select("g", "n", "k", "rate"), ["g"]).collect()} == {("b", "missing"), ("c", "unsupported")}
    o = spark.createDataFrame([(i, s, bool(int(x))) for s, xs in (("F0", "00011"), ("F7", "11101")) for i, x in enumerate(xs)], "i int, s string, ok boolean")
    t = gates.paired_test(o, "i", "s", "F0", "F7", "ok").first()
    assert (t.n, t.gained, t.lost, t.p) == (5, 3, 1, 0.625)


def test_checks(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {(r.k, r.side) for r in V.coverage(a, b, "k").collect()} == {("x", "missing"), ("z", "extra")}
    lock, found = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert {(r.path, r.status) for r in V.digest_changes(lock, found).collect()} == {("a", "OK"), ("b", "CHANGED"), ("c", "MISSING"), ("d", "ADDED")}
    d = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "a string, b string").select(V.row_digest(F.col("a"), F.col("b")).alias("h")).distinct()
    assert d.count() == 3


def test_answers(spark):
    d = spark.createDataFrame([("答案：12,3\n單位：千元\n期間：FY2023\n依據：[1]、[3][1]",), ("就是這樣",), ("答案：\n單位：無",)], "t string")
    got = [r.a for r in d.select(A.parse_answer(F.col("t")).alias("a")).collect()]
    assert (got[0].answer, got[0].unit, got[0].period, got[0].citations) == ("12,3", "千元", "FY2023", [1, 3]) and got[1].answer == "就是這樣" and got[1].unit is None and got[2].unit is None
    hits = spark.createDataFrame([("q", 1, "d", [1], "甲"), ("q", 2, "e", [2, 3], None)], "query string, rank int, doc_id string, pages array<int>, text string")
    p = A.build_prompts(spark.createDataFrame([("q", "多少"), ("r", "無")], "query string, question string"), hits)
    text = {r["query"]: r.prompt for r in p.collect()}
    assert text["q"].startswith("[1] d p1\n甲\n\n[2] e p2,3\n") and "問題：無" in text["r"]
    c = A.valid_citations(spark.createDataFrame([("q", [1, 9])], "query string, citations array<int>"), hits).collect()
    assert {(r.citation, r.valid) for r in c} == {(1, True), (9, False)}
    assert [r["rank"] for r in A.rerank(hits, F.lit(1.0)).orderBy("before").collect()] == [1, 2]


@pytest.mark.parametrize("hot", [10**6, 5])
def test_carry_forward(spark, hot):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i % 7, i, rng.choice([None, None, f"u{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, t int, i int, unit string")
    got = {r.i: (r.unit, r.inherited) for r in facts.carry_forward(df, "g", ["t", "i"], "unit", hot).collect()}
    for g in ("a", "b", None):
        last = None
        for _, t, i, u in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            last = u or last
            assert got[i] == (last, u is None)
    assert facts.carry_forward(df.limit(0), "g", ["t", "i"], "unit", hot).count() == 0


def test_similar_texts_shuffle_no_unlike_pairs(spark):
    """Texts that share bigrams but are unlike: under 200 bytes a text are shuffled (339 when all that meet were)."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(30)) for _ in range(1200)]
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 0.8)[0].count() == 0
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 200 * len(texts)


def test_similar_texts_of_any_characters(spark):
    """Characters of more than sixteen bits, single ones and the null character are told apart."""
    texts = ["𠀀𠀁𠀂", "𠀀𠀁", "𠀁", "甲", "甲\x00", "\x00", "\x01", "𠀀𠀁𠀃", "𠀀𠀁 𠀂"]
    pairs, members = similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", 0.3)
    assert {(r.id, r["class"]) for r in members.collect()} == {(i, i) for i in range(8)} | {(8, 0)}
    assert {(r.class_1, r.class_2, r.similarity) for r in pairs.collect()} == {(0, 1, 0.5), (0, 7, 0.333), (1, 7, 0.5)}
