"""Small tables as text: manifests, reports, annotation forms and catalogues of endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: The fields of an annotation form.
FORM = ["Q", "A", "UNIT", "CURRENCY"]
NO_VALUE = "—"


def manifest_lines(rows: DataFrame, key: str, header: str) -> DataFrame:
    """Rows as lines of YAML, one row: a comment, then a list of mappings in the order of ``key``, fields in the order of the columns, values as JSON; nulls are null."""
    field = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`").cast("string").alias("v"))), r'^\{"v":|\}$', ""), F.lit("null")))
    value = lambda c: F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: null")).otherwise(field(c))
    text = F.concat(F.lit("- "), F.array_join(F.array(*[value(c) for c in rows.columns]), "\n  "))
    lines = rows.select(F.col(key).alias("k"), text.alias("t")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x.t), "\n").alias("t"))  # a manifest is small
    return lines.select(F.concat(F.lit("# " + header.replace("\n", "\n# ") + "\n"), "t", F.lit("\n")).alias("value"))


def read_manifest(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of manifests (value: whole texts) as ``manifest_lines`` writes them; a text without records is an empty table."""
    lines = text.select("value", F.monotonically_increasing_id().alias("file")).select("file", F.posexplode(F.split("value", "\n")).alias("n", "line")).where("trim(line) <> '' and not ltrim(line) like '#%'")
    w = Window.partitionBy("file").orderBy("n")
    r = lines.withColumn("record", F.count_if(F.col("line").startswith("- ")).over(w)).select("file", "record", F.regexp_extract("line", r"^(?:- |  )([^:]+): (.*)$", 1).alias("k"), F.regexp_extract("line", r"^(?:- |  )([^:]+): (.*)$", 2).alias("v"))
    said = F.get_json_object(F.concat(F.lit('{"v":'), "v", F.lit("}")), "$.v")
    wide = r.groupBy("file", "record").agg(*[F.max(F.when(F.col("k") == f.name, said)).alias(f.name) for f in schema])
    return wide.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def provenance(declared: DataFrame, lock: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What is declared, each with what the lock holds of it; what it lacks is a dash."""
    return declared.join(lock.select(key, *fields), key, "left").select(*declared.columns, *[F.coalesce(F.col(f).cast("string"), F.lit(NO_VALUE)).alias(f) for f in fields])


def markdown_report(rates: DataFrame, limitation: str, lock: str) -> DataFrame:
    """Rates (name, n, k, rate) as a table in Markdown: place, line.  A report without its limitation, its lock's digest or a denominator is refused."""
    if not limitation.strip() or len(lock) != 64:
        raise ValueError("a report states its limitation and the digest of its lock")
    if not rates.where("n is null or (n = 0 and rate is not null)").isEmpty():
        raise ValueError("a rate without its denominator can't be reported")
    row = F.format_string("| %s | %d / %d | %s |", "name", "k", "n", F.coalesce(F.format_number(F.col("rate") * 100, 2), F.lit(NO_VALUE)))
    body = rates.select((F.row_number().over(Window.orderBy("name")) + 3).alias("place"), row.alias("line"))  # a handful of rows
    head = [(0, limitation), (1, f"lock: {lock}"), (2, "| name | k / n | % |"), (3, "|-|-|-|")]
    return rates.sparkSession.createDataFrame(head, "place int, line string").unionByName(body)


def parse_forms(lines: DataFrame) -> DataFrame:
    """Annotation forms (file, n, line) as rows: id and its fields; a line ``ID x`` opens a form, lines before the first belong to none, blank fields are null, the last of a field counts."""
    w = Window.partitionBy("file").orderBy("n")
    opens = F.nullif(F.regexp_extract("line", r"^ID\s+(\S+)\s*$", 1), F.lit(""))
    f = lines.withColumn("id", F.last(opens, ignorenulls=True).over(w)).where("id is not null")
    pattern = rf"^({'|'.join(FORM)}):\s*(.*?)\s*$"
    f = f.select("file", "n", "id", F.regexp_extract("line", pattern, 1).alias("k"), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")).alias("v"))
    return f.groupBy("file", "id").agg(*[F.max_by(F.when(F.col("k") == c, F.col("v")), F.when(F.col("k") == c, F.col("n"))).alias(c.lower()) for c in FORM])


def mentions(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of some words; null holds none."""
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(False))


def endpoint_catalogue(specs: DataFrame, words: list[str]) -> DataFrame:
    """Endpoints of interface descriptions (value: JSON): path, summary, fields of what it returns (references followed), relevant (a word stands in summary or fields)."""
    kind = "struct<paths:map<string,struct<get:struct<summary:string,responses:map<string,struct<schema:struct<items:struct<`$ref`:string>>>>>>>,definitions:map<string,struct<properties:map<string,string>>>>"
    s = specs.select(F.from_json("value", kind).alias("s")).select(F.explode("s.paths").alias("path", "e"), F.col("s.definitions").alias("known"))
    name = F.regexp_extract(F.col("e.get.responses")["200"]["schema"]["items"]["$ref"], "([^/]+)$", 1)
    fields = F.coalesce(F.array_sort(F.map_keys(F.col("known")[name]["properties"])), F.array().cast("array<string>"))
    e = s.select("path", F.col("e.get.summary").alias("summary"), fields.alias("fields"))
    return e.withColumn("relevant", mentions(F.concat_ws(" ", "summary", F.array_join("fields", " ")), words))


def endpoint_profile(rows: DataFrame) -> DataFrame:
    """Rows of an endpoint (row: a map) by year and quarter: year, quarter, n, columns (the most that a row has)."""
    return rows.groupBy(F.col("row")["年度"].alias("year"), F.col("row")["季別"].alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("row")).alias("columns"))
