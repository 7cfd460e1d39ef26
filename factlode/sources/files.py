"""Files and addresses: digests, allowed hosts, what a file name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factlode.functions.keys import fold_width


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of each file, and text_sha256: of its text without byte-order mark, with \\n line ends and one at the end."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", ""), "\r\n?", "\n"), r"\s+$", "")
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(F.concat(text, F.lit("\n")), "UTF-8"), 256).alias("text_sha256"))


def url_problem(url: Column, hosts: list[str]) -> Column:
    """Why an address may not be fetched: scheme, credentials, port, ip_literal or host; null where it may."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(~F.coalesce(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)) == "https", F.lit(False)), "scheme").when(F.contains(rest, F.lit("@")), "credentials").when(rest.rlike(r":[0-9]+$") & ~rest.rlike(":443$"), "port")
        .when(host.rlike(r"^[0-9.]+$") | host.rlike(r"^\[") | host.rlike("^0x"), "ip_literal").when(~F.coalesce(host.isin(hosts), F.lit(False)), "host")
    )


def identify(name: Column, cover: Column) -> list[Column]:
    """code, fiscal_year and doc_type of a filing by file name and cover text, and status: OK, CONFLICT or UNKNOWN."""
    n, c = fold_width(name), F.regexp_replace(fold_width(cover), r"(?U)\s+", "")
    code_n, year_n = F.regexp_extract(n, r"(?:^|[^0-9])([0-9]{4})[-_]?(?:FY)?(?:20|1)[0-9]{2}", 1), F.regexp_extract(n, r"(?:FY)?(20[0-9]{2})", 1)
    roc_n = F.regexp_extract(n, r"[-_]([0-9]{3})(?:[-_]|Q|\.)", 1)
    code_c = F.regexp_extract(c, r"(?:股票代[號碼]|公司代[號碼]|證券代[號碼])[::]?([0-9]{4})", 1)
    roc_c = F.translate(F.regexp_extract(c, "(?:民國)?([0-9]{2,3}|[一二三四五六七八九〇○零]{2,3})年(?:度|報|股東)", 1), "一二三四五六七八九〇○零", "123456789000")
    roc = lambda x: F.when(x.try_cast("int").between(90, 130), x.try_cast("int") + 1911)
    year_a, year_b = F.coalesce(year_n.try_cast("int"), roc(roc_n)), roc(roc_c)
    code_a, code_b = F.nullif(code_n, F.lit("")), F.nullif(code_c, F.lit(""))
    kind = F.when(c.rlike("年報"), "annual_report").when(c.rlike("財務報[告表]"), "financial_report")
    clash = F.coalesce(code_a != code_b, F.lit(False)) | F.coalesce(year_a != year_b, F.lit(False))
    code, year = F.coalesce(code_a, code_b), F.coalesce(year_a, year_b)
    status = F.when(clash, "CONFLICT").when(code.isNull() | year.isNull(), "UNKNOWN").otherwise("OK")
    return [code.alias("code"), year.alias("fiscal_year"), kind.alias("doc_type"), status.alias("status")]


def rename_plan(found: DataFrame) -> DataFrame:
    """Files (doc_id, name, code, fiscal_year, doc_type, status of ``identify``) with the name each should have: target and action.

    keep: it has it; rename; conflict: two files ask for one name; unidentified: no name can be made (target null).
    """
    target = F.when((F.col("status") == "OK") & F.col("doc_type").isNotNull(), F.concat("code", F.lit("-FY"), F.col("fiscal_year").cast("string"), F.lit("-"), "doc_type", F.lit(".pdf")))
    f = found.withColumn("target", target)
    wanted = f.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("files"))
    action = F.when(F.col("target").isNull(), "unidentified").when(F.col("files") > 1, "conflict").when(F.col("name") == F.col("target"), "keep").otherwise("rename")
    return f.join(wanted, "target", "left").select("doc_id", "name", "target", action.alias("action"))
