"""Derived tables on disk, with a manifest that a later read is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factlode.operators.lexical import postings

TOKENISER = "cjk-bigram-ascii-v1"


def save_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Postings by hash of the term, document lengths and a manifest.  A corpus without terms is refused."""
    post = postings(docs, id_col, text_col)
    post.repartition("term").sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
    spark = docs.sparkSession
    p = spark.read.parquet(f"{path}/postings")
    m = p.agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("doc").alias("documents"), F.count_distinct("term").alias("terms"), F.sum("tf").alias("tokens"))
    if not m.first()["tokens"]:
        raise ValueError("a corpus without terms can't be searched")
    m.withColumn("tokeniser", F.lit(TOKENISER)).write.parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and the problems that keep them from being used: (postings, problems); no problems, no rows."""
    p, m = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/manifest")
    now = p.agg(F.count(F.lit(1)).alias("postings_now"), F.count_distinct("doc").alias("documents_now"), F.count_if((F.col("tf") < 1) | (F.col("tf") > F.col("len"))).alias("bad"))
    j = m.crossJoin(F.broadcast(now))  # one row each
    problems = F.array_compact(F.array(F.when(F.col("tokeniser") != TOKENISER, "tokeniser"), F.when(F.col("postings") != F.col("postings_now"), "postings"), F.when(F.col("documents") != F.col("documents_now"), "documents"), F.when(F.col("bad") > 0, "frequency")))
    return p, j.select(F.explode(problems).alias("problem"))


def vector_problems(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Rows that can't be searched, and why: null, dimension, not_finite, zero, not_unit."""
    norm = F.sqrt(F.aggregate(F.col(vec_col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    why = F.when(F.col(vec_col).isNull(), "null").when(F.size(vec_col) != dim, "dimension").when(norm.isNull() | F.isnan(norm) | (norm == float("inf")), "not_finite").when(norm == 0, "zero").when(F.abs(norm - 1) > 1e-3, "not_unit")
    return vectors.select(id_col, why.alias("problem")).where("problem is not null")


def mark_once(spark: SparkSession, path: str) -> None:
    """Creates a marker; a second call fails."""
    spark.range(1).write.mode("errorifexists").parquet(path)
