"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from factlode.operators import validate as V  # noqa: F401
from factlode.sources import files, jsonl, openapi, stores
from factlode.streaming import events as E


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('// note\n{"a": 1, "b": "x\u2028y"}\n\n{"b": "z"}\n{"a": 2, "c": 3}\n[1]\nnot\n', encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType())])
    ok, bad = jsonl.read_jsonl(spark, str(tmp_path / "in.jsonl"), schema)
    assert [(r.a, r.b) for r in ok.collect()] == [(1, "x\u2028y")]
    assert sorted(r.problem for r in bad.collect()) == ["missing:a", "not_an_object", "not_an_object", "unknown:c"]
    jsonl.write_jsonl(ok, str(tmp_path / "out"))
    lines = [p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.txt")]
    assert any("\\u2028" in t and json.loads(t.strip()) == {"a": 1, "b": "x\u2028y"} for t in lines)


def test_openapi(spark, tmp_path):
    rows = [{"年度": "112", "季別": "4", "公司代號": "2330", "公司名稱": "甲", "營業收入(百萬元)": "1,234.5", "毛利率(%)": "53", "備註": "--"}, {"年度": "113", "公司代號": "2317", "淨利": "(7)"}, {"公司代號": "1"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    got = {(r.company_code, r.period, r.account, r.unit, float(r.value)) for r in openapi.unpivot_rows(openapi.read_rows(spark, str(tmp_path / "a.json")), "千元").collect()}
    assert got == {("2330", "FY2023Q4", "營業收入", "百萬元", 1234.5), ("2330", "FY2023Q4", "毛利率", "%", 53.0), ("2317", "FY2024", "淨利", "千元", -7.0)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("\ufeffx\r\ny \r\n".encode())
    (tmp_path / "b.txt").write_bytes(b"x\ny\n")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got["a.txt"].sha256 != got["b.txt"].sha256 and got["a.txt"].text_sha256 == got["b.txt"].text_sha256
    d = spark.createDataFrame([("https://data.example/a",), ("http://data.example",), ("https://u@data.example/",), ("https://10.0.0.1/",), ("https://else.example/",), (None,), ("https://data.example:8443/",)], "u string")
    assert [r.p for r in d.select(files.url_problem(F.col("u"), ["data.example"]).alias("p")).collect()] == [None, "scheme", "credentials", "ip_literal", "host", "scheme", "port"]
    n = spark.createDataFrame([("2330-FY2023-AR.pdf", "股票代號：2330 民國一一二年度年報"), ("2330_2023.pdf", "股票代號：2317"), ("x.pdf", "")], "n string, c string").select(*files.identify(F.col("n"), F.col("c"))).collect()
    assert [(r.code, r.fiscal_year, r.status) for r in n] == [("2330", 2023, "OK"), ("2330", 2023, "CONFLICT"), (None, None, "UNKNOWN")]


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "毛利率 上升"), (2, "負債")], "id int, t string")
    stores.save_index(docs, "id", "t", str(tmp_path / "i"))
    post, problems = stores.load_index(spark, str(tmp_path / "i"))
    assert post.count() == 4 and problems.count() == 0
    with pytest.raises(ValueError):
        stores.save_index(docs.limit(0), "id", "t", str(tmp_path / "e"))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [2.0, 0.0])], "id int, v array<double>")
    assert {r.id: r.problem for r in stores.vector_problems(v, "id", "v", 2).collect()} == {2: "null", 3: "zero", 4: "dimension", 5: "not_finite", 6: "not_unit"}
    stores.mark_once(spark, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exists"):
        stores.mark_once(spark, str(tmp_path / "m"))


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    rows = lambda xs: spark.createDataFrame(xs, "id int, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    rows([(1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:10:00", 2.0), (1, "2024-01-01 00:20:00", 3.0)]).coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for _ in range(2):
        E.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "t"), ["id"], ["at"], str(tmp_path / "c")).awaitTermination()
        rows([(2, "2024-01-01 05:00:00", 9.0), (3, "2023-01-01 00:00:00", 4.0)]).coalesce(1).write.mode("append").parquet(str(src))
    assert {r.id: r.v for r in E.current(spark, str(tmp_path / "t"), ["id"], ["at"]).collect()} == {1: 3.0, 2: 9.0, 3: 4.0}
    for k in range(6):
        rows([(7, f"2025-01-0{k + 1} 00:00:00", float(k)), (10 + k, "2025-01-01 00:00:00", 0.0)]).coalesce(1).write.mode("append").parquet(str(src))
        E.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "u"), ["id"], ["at"], str(tmp_path / "cu"), 2).awaitTermination()
    left = sorted(p.name.split("=") for p in (tmp_path / "u").iterdir() if "=" in p.name)
    assert [int(n) for k, n in left if k == "base"] == [3, 5] and min(int(n) for k, n in left if k == "delta") == 4
    got = {r.id: r.v for r in E.current(spark, str(tmp_path / "u"), ["id"], ["at"]).collect()}
    assert got[7] == 5.0 and set(got) == {1, 2, 3, 7, *range(10, 16)} and E.current(spark, str(tmp_path / "none"), ["id"], ["at"]) is None
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    for name, df in (("w", E.windowed(stream(), "at", ["id"], "v")), ("s", E.sessions(stream(), "at", "id")), ("d", E.without_repeats(stream(), "at", ["id"]))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() >= 1
