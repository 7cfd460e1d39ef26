"""Lines of JSON: strict schemas in, stable text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold a record: split at \\n only, blank lines and // comments left out; file, line."""
    t = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))
    return t.where("trim(line) <> '' and not ltrim(line) like '//%'")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of a schema, and the problems of lines that are none: (records, problems).

    A line that is no object, lacks a required field or has an unknown one is a problem row, and no record.
    """
    lines = read_lines(spark, path)
    names = [f.name for f in schema]
    need = [f.name for f in schema if not f.nullable]
    keys = F.json_object_keys("line")
    lacks = F.array_except(F.array(*[F.lit(n) for n in need]).cast("array<string>"), keys)
    unknown = F.array_except(keys, F.array(*[F.lit(n) for n in names]))
    kind = F.when(keys.isNull(), "not_an_object").when(F.size(lacks) > 0, F.concat(F.lit("missing:"), F.array_join(lacks, ","))).when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.array_join(unknown, ",")))
    judged = lines.withColumn("problem", kind)
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    records = judged.where("problem is null").select(F.from_json("line", loose).alias("r")).select("r.*")
    return records, judged.where("problem is not null").select("file", "line", "problem")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per row, all columns in order; the separators U+0085, U+2028 and U+2029 are escaped, other text stays as it is."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    for c in ("\x85", "\u2028", "\u2029"):
        line = F.replace(line, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    df.select(line.alias("value")).write.text(path)
