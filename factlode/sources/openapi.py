"""Wide rows of an open-data interface as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factlode.functions.text import parse_amount

#: Columns that identify a row; every other column is an account.
IDENTITY = ["年度", "季別", "公司代號", "公司名稱", "出表日期"]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of flat objects, as a map per row (columns differ between rows)."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.explode(F.from_json("value", T.ArrayType(T.MapType(T.StringType(), T.StringType())))).alias("row"))


def unpivot_rows(rows: DataFrame, default_unit: str | None, companies: list[str] | None = None) -> DataFrame:
    """Facts of wide rows: company_code, period, account, unit, value.

    The period is the year of the republic plus 1911 with its quarter; a row without one is left out.  A unit in brackets at
    the end of a column's name is its unit, else ``default_unit``; placeholders are no figures.  Companies are kept to ``companies`` before
    columns become rows.
    """
    r = rows.select(F.col("row")["公司代號"].alias("company_code"), F.col("row")["年度"].try_cast("int").alias("year"), F.col("row")["季別"].try_cast("int").alias("quarter"), "row").where("company_code is not null and year is not null")
    if companies is not None:
        r = r.where(F.col("company_code").isin(companies))
    period = F.concat(F.lit("FY"), (F.col("year") + 1911).cast("string"), F.when(F.col("quarter").isNotNull(), F.concat(F.lit("Q"), F.col("quarter").cast("string"))).otherwise(""))
    e = r.select("company_code", period.alias("period"), F.explode("row").alias("name", "text")).where(~F.col("name").isin(IDENTITY))
    unit = F.regexp_extract("name", r"[(（]((?:新?[臺台]幣)?(?:百萬|十億|億|萬|千|仟)?元|%|％|倍|千股|仟股|股)[)）]\s*$", 1)
    account = F.when(unit != "", F.regexp_replace("name", r"\s*[(（][^()（）]*[)）]\s*$", "")).otherwise(F.col("name"))
    return e.select("company_code", "period", account.alias("account"), F.when(unit != "", unit).otherwise(F.lit(default_unit)).alias("unit"), parse_amount(F.col("text")).alias("value")).where("value is not null")
