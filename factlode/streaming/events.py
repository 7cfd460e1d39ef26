"""Structured streaming: windowed counts, late data, and upserts batch by batch.

The engine this library serves has no streams of its own; these carry its ledgers (last record wins, repeats dropped) to data that arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factlode.operators.facts import last_wins


def windowed(events: DataFrame, at: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and key; records later than ``late`` behind the newest are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events without a gap: start, end, n."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def without_repeats(events: DataFrame, at: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


#: Deltas after which a table is written whole.
COMPACT = 16


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Keeps a table of the last record per key: a batch writes what it brings, by its number, so a batch run twice changes nothing.

    Every ``compact`` batches the table is written whole, and what lies before the whole one before that is deleted: a reader
    that began on either still finds its files.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last_wins(batch, keys, order).write.mode("overwrite").parquet(f"{path}/delta={number:012d}")
        if (number + 1) % compact == 0:
            current(spark, path, keys, order, number).write.mode("overwrite").parquet(f"{path}/base={number:012d}")
            bases = [n for k, n in _parts(spark, path) if k == "base" and n < number]
            for kind, n in _parts(spark, path) if bases else []:
                if n < max(bases) or (kind == "delta" and n == max(bases)):
                    fs, root = _files(spark, path)
                    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{kind}={n:012d}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _parts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Whole tables and deltas that were written to their end: (base or delta, number)."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    done = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(at(s.getPath(), "_SUCCESS"))]
    return sorted((k, int(n)) for k, n in (x.split("=") for x in done if "=" in x))


def current(spark: SparkSession, path: str, keys: list[str], order: list[str], upto: int | None = None) -> DataFrame | None:
    """The table as of the last batch (or batch ``upto``); None where there is none."""
    parts = [(k, n) for k, n in _parts(spark, path) if upto is None or n < upto or (n == upto and k == "delta")]
    base = max((n for k, n in parts if k == "base"), default=None)
    names = ([] if base is None else [f"base={base:012d}"]) + [f"delta={n:012d}" for k, n in parts if k == "delta" and (base is None or n > base)]
    return last_wins(spark.read.parquet(*[f"{path}/{n}" for n in names]), keys, order) if names else None
