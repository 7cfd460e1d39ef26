"""Named queries on tables of a few rows."""

from factlode.plans import evaluation, retrieval, structure


def test_prompts_of_every_question(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(f"Q-{i}", f"問{i}") for i in (50, 51, 7)] + [("Q-x", "問x")], "question_id string, question string").write.parquet(f"{d}/gold.parquet")
    spark.createDataFrame([("c1", "甲"), ("c2", "乙")], "chunk_id string, text string").write.parquet(f"{d}/chunk.parquet")
    hits = [(q, c, "rerank", r, "d", [r]) for q, c, r in (("Q-50", "c1", 1), ("Q-51", "c2", 1), ("Q-51", "c1", 2), ("Q-7", "c1", 6), ("Q-x", "c2", 5))] + [("Q-7", "c2", "dense", 1, "d", [1])]
    spark.createDataFrame(hits, "question_id string, chunk_id string, retriever string, rank int, doc_id string, pages array<int>").write.parquet(f"{d}/hit.parquet")
    got = {r["query"]: r.prompt.split("\n請依")[0] for r in structure.prompts(spark, d).collect()}
    assert got == {"Q-50": "[1] d p1\n甲\n\n問題：問50", "Q-51": "[1] d p1\n乙\n\n[2] d p2\n甲\n\n問題：問51", "Q-7": "\n\n問題：問7", "Q-x": "[1] d p5\n乙\n\n問題：問x"}


def test_worklist_of_every_topic(spark, tmp_path):
    d = str(tmp_path)
    texts = {
        ("a", 1): "綜合損益表 營業 收入 1,000 每股盈餘 2", ("a", 2): "營業收入 1,000 2,000 營業毛利 3,000", ("a", 3): "營業收入 1,000 2,000 資產總計 9,000 8,000", ("a", 4): "資產負債表 資產總額 1,000 資產總計",
        ("a", 5): "資產總額", ("b", 1): "本期淨利 7", ("b", 2): "淨利（淨損） 1,234,567 營業利益", ("b", 3): "無", ("b", 4): None,
    }
    spark.createDataFrame([(f"{k}{p}", k, 0, [p], t) for (k, p), t in texts.items()], "chunk_id string, doc_id string, chunk_index int, pages array<int>, text string").write.parquet(f"{d}/chunk.parquet")
    rows = evaluation.worklist(spark, d).collect()
    got = {(r.doc_id, r.topic, r["rank"]): (r.page, r.term, r.figures) for r in rows}
    assert got == {
        ("a", "revenue", 1): (3, "營業收入", 4), ("a", "revenue", 2): (2, "營業收入", 3), ("a", "gross_profit", 1): (2, "營業毛利", 3), ("a", "eps", 1): (1, "每股盈餘", 1),
        ("a", "total_assets", 1): (3, "資產總計", 4), ("a", "total_assets", 2): (4, "資產總額", 1), ("b", "net_income", 1): (2, "淨利（淨損）", 1), ("b", "net_income", 2): (1, "本期淨利", 0), ("b", "operating_income", 1): (2, "營業利益", 1),
    }
    assert {r.headings for r in rows if r.doc_id == "a"} == {"綜合損益表:1;資產負債表:4"}
    assert next(r for r in rows if r.topic == "eps").excerpt == "綜合損益表營業收入1,000每股盈餘2" and next(r for r in rows if r.topic == "eps").page_headings == "綜合損益表"


def test_bm25_topk_searches_every_question(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([("Q-50", "毛利"), ("Q-51", "負債"), ("Q-x", "毛利"), ("Q-51", "負債"), ("Q-7", None), (None, "毛利")], "question_id string, question string").write.parquet(f"{d}/gold.parquet")
    spark.createDataFrame([("c1", "毛利"), ("c2", "毛利 負債 負債"), ("c3", None), ("c1", "毛利")], "chunk_id string, text string").write.parquet(f"{d}/chunk.parquet")
    got = sorted((r["query"], r["rank"], r.doc) for r in retrieval.bm25_topk(spark, d).collect())
    assert got == [("Q-50", 1, "c1"), ("Q-50", 2, "c2"), ("Q-51", 1, "c2"), ("Q-x", 1, "c1"), ("Q-x", 2, "c2")]
