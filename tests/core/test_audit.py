"""Audit samples, leakage and citations."""

import random

from factlode.operators.audit import audit_sample, grade_citations, leakage


def test_sample_equals_the_twister_on_sorted_ids(spark):
    ids = [f"Q{i:03d}" for i in range(60)]
    g = spark.createDataFrame([(i, "chart_value_trend" if k % 20 == 0 else "narrative_fact") for k, i in enumerate(ids)] + [("Q001", "narrative_fact"), (None, "x")], "question_id string, question_type string")
    rest = sorted(i for k, i in enumerate(ids) if k % 20)
    got = {(r.question_id, r.why) for r in audit_sample(g).collect()}
    assert got == {(i, "sampled") for i in random.Random(20260731).sample(rest, 8)} | {(i, "always") for i in ids[::20]}
    assert audit_sample(g.limit(0)).count() == 0


def test_leakage(spark):
    rows = [("a", "dev", "甲公司營業收入是多少元呢", ("n", "1")), ("b", "locked", "甲公司營業收入是多少元啊", ("n", "0001")), ("c", "locked", "完全不同的問題", ("n", "2")), ("d", "dev", "完全不同的問題", (None, None)), ("e", "probe", None, None)]
    g = spark.createDataFrame([(*r, ["0001-FY2020-AR"] if r[0] in "ab" else None) for r in rows], "question_id string, question_set string, question string, company struct<name:string,code:string>, source_document array<string>")
    assert {(r.kind, r.key) for r in leakage(g).collect()} == {("company", "0001"), ("document", "0001-FY2020-AR"), ("question", "a|b"), ("question", "c")}


def test_citations(spark):
    c = spark.createDataFrame([("q", "d", 3, None, None, False), ("r", "d", 3, "收入", "112年", False), ("s", None, None, None, None, True), ("t", "x", 1, None, None, False), ("u", None, None, None, None, False)], "query string, doc_id string, page int, row string, column string, refused boolean")
    e = spark.createDataFrame([("q", "page", "d", 3, None, None), ("q", "page", "d", 4, None, None), ("r", "table_cell", "d", 3, "收入", "112年度"), ("t", "page", "d", 1, None, None)], "query string, kind string, doc_id string, page int, row string, column string")
    got = {r["query"]: (r.met, r.valid) for r in grade_citations(c, e).collect()}
    assert got == {"q": (1, True), "r": (1, True), "s": (0, None), "t": (0, False), "u": (0, False)}


def test_leakage_shuffles_no_unlike_pairs(spark):
    """Unlike questions that share bigrams: under 400 bytes a question are shuffled (615 when all that meet were, and texts were cut three times)."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(30)) for _ in range(1200)]
    g = spark.createDataFrame([(str(i), "dev", t, None, None) for i, t in enumerate(texts)], "question_id string, question_set string, question string, company struct<name:string,code:string>, source_document array<string>")
    written = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert leakage(g).count() == 0
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before < 400 * len(texts)
