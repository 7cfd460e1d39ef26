"""Session helpers: reading tables, the shared folder, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table by name; every table lies in one Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` names it.  Only a local session without that setting gets a temporary
    folder of its own; on a cluster its absence is an error, as a machine-local folder would not survive.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="factlode-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one: all tables that cut lineage lie in it."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables in the shared folder.  To be called when no result that was not written is read any more."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def once_each(df: DataFrame, key: str) -> DataFrame:
    """One row per ``key``, on as many partitions as there are cores at least: costly work may follow, so they are not to be merged for being small."""
    return df.repartition(width(df.sparkSession), key).dropDuplicates([key])


def width(spark: SparkSession) -> int:
    """Partitions of a stage that is to use every core."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialise(df: DataFrame, tag: str = "t", by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, so a lost executor costs
    no recomputation and every reader sees the same rows.  It lies there until ``clear``.  by: a column whose values lie in folders of their own."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def temp_name(taken: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``taken`` (compared without case, as Spark does)."""
    low, name, k = {c.lower() for c in taken}, wanted, 0
    while name.lower() in low:
        k += 1
        name = f"{wanted}_{k}"
    return name
