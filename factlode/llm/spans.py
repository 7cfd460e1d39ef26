"""Long exact spans that different texts share, by an index of window hashes that grows run by run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factlode.llm.bpe import codes
from factlode.llm.encode import slices
from factlode.llm.winnow import GRAM, SPAN, choose, gram_hashes, periodic_runs, side_hashes
from factlode.runtime import materialise, shared_dir, width

#: Runs of one level that are merged into one of the next, and batches that a table is taken in when it comes at once.
FANOUT, BATCHES = 4, 2
_MANIFEST = "level int, run string, buckets int, gram int, span int, id_type string"


def _texts(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """Documents that can share a span: id, text, and cid, by which equal texts are one."""
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where((F.length("text") >= span) & F.col("id").isNotNull())
    return t.select("id", F.unhex(F.md5("text")).alias("cid"), "text")


def fingerprints(texts: DataFrame, gram: int, span: int, parts: int) -> DataFrame:
    """print, cid, place, the least id, left and right (see ``side_hashes``) of each chosen window of ``texts`` (id, cid, text), laid out by print in ``parts`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, blob, sizes in slices(batch.column(2)):
                cp = codes(blob)
                owner, place, h = choose(cp, sizes, gram, span)
                left, right, has_left, has_right = side_hashes(cp, sizes, owner, place, gram, span)
                took = pa.array(owner + a)
                sides = [pa.array(x.view(np.int64), mask=~there) for x, there in ((left, has_left), (right, has_right))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), pa.array(place, pa.int32()), pa.array(h.view(np.int64)), *sides], names=["id", "cid", "place", "print", "left", "right"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.select("id", "cid", "text").mapInArrow(run, f"id {kind}, cid binary, place int, print bigint, left bigint, right bigint")
    # laid out by print at once, so that neither the grouping nor the run needs another exchange
    return _once(found.repartition(parts, "print"))


def _once(prints: DataFrame) -> DataFrame:
    """One row for each place of a text, however many documents have it."""
    return prints.groupBy("print", "cid", "place").agg(F.min("id").alias("id"), F.first("left").alias("left"), F.first("right").alias("right"))


class FingerprintIndex:
    """Window hashes of all texts seen so far, in sorted runs that are never changed, under a folder that outlives the session.

    A run lies in buckets by print, each sorted, so joins of runs need no exchange.  ``add`` writes a batch as a run of its own and merge-joins it
    with the runs that stand.  Before a batch comes, FANOUT runs of a level are merged into one of the next, so it meets a number of runs that
    grows with the logarithm of the history.  ``links`` verifies, in the texts themselves, what the joins of this session found.

    path: a folder of the index; one that holds an index is opened (its gram, span and buckets hold, whatever is asked for).
    """

    def __init__(self, spark: SparkSession, gram: int = GRAM, span: int = SPAN, fanout: int = FANOUT, path: str | None = None, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str]] = []
        self.hits: list[DataFrame] = []
        self.gram, self.span, self.buckets, self.id_type = gram, span, buckets or width(spark), ""
        if path and self._stored():
            newest = self._manifests().agg(F.max("version")).first()[0]
            for r in spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/version={newest}").collect():  # a row per run: their number grows with the logarithm of the batches
                self.gram, self.span, self.buckets, self.id_type = r["gram"], r["span"], r["buckets"], r["id_type"]
                self.runs.append((r["level"], r["run"]))
        if not 0 < 2 * self.gram < self.span:
            raise ValueError("a gram must be shorter than half the span, so that the ends of periodic runs meet as whole")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST + ", version int").json(f"{self.path}/manifest")

    def _stored(self) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def _save(self) -> None:
        """A manifest of the runs that stand, beside those before: whoever reads the newest sees whole runs only."""
        version = (self._manifests().agg(F.max("version")).first()[0] or 0) + 1 if self._stored() else 1
        rows = [(level, run, self.buckets, self.gram, self.span, self.id_type) for level, run in self.runs]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/version={version}")

    def _read(self, run: str) -> DataFrame:
        """A stored run, known to lie in sorted buckets."""
        if not self.spark.catalog.tableExists(run):
            cols = f"print BIGINT, cid BINARY, place INT, id {self.id_type}, left BIGINT, right BIGINT"
            self.spark.sql(f"CREATE TABLE {run} ({cols}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(run)

    def _write(self, prints: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        prints.select("print", "cid", "place", "id", "left", "right").write.format("parquet").bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{run}").saveAsTable(run)
        return run

    def add(self, texts: DataFrame) -> None:
        """Takes a batch of texts (id, cid, text)."""
        self._compact()
        self.id_type = texts.schema["id"].dataType.simpleString()
        run = self._write(fingerprints(texts, self.gram, self.span, self.buckets))
        self._meet(self._read(run))
        self.runs.append((0, run))
        self._save()

    def add_in_batches(self, texts: DataFrame, batches: int = BATCHES) -> None:
        """Takes texts as so many batches; equal texts are of one batch."""
        for b in range(batches):
            self.add(texts.where(F.pmod(F.xxhash64("cid"), F.lit(batches)) == b) if batches > 1 else texts)

    def met(self, new: DataFrame) -> DataFrame | None:
        """Windows of the history whose hash a batch has too: every run by itself, bucket by bucket."""
        own = new.select("print").distinct()
        old = None
        for _, run in self.runs:
            got = self._read(run).hint("merge").join(own, "print", "left_semi")
            old = got if old is None else old.unionAll(got)
        return old

    def _meet(self, new: DataFrame) -> None:
        found = new.groupBy("print").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a != b").select("print")
        old = self.met(new)
        if old is not None:
            old = materialise(old, "met")
            self.hits.append(old)
            found = found.unionAll(old.select("print")).distinct()
        self.hits.append(materialise(new.join(found, "print", "left_semi"), "met"))

    def _compact(self) -> None:
        level = 0
        while len(same := [r for n, r in self.runs if n == level]) >= self.fanout:
            merged = self._read(same[0])
            for r in same[1:]:
                merged = merged.unionAll(self._read(r))
            merged = _once(merged.repartition(self.buckets, "print"))
            self.runs = [(n, r) for n, r in self.runs if n != level] + [(level + 1, self._write(merged))]
            level += 1

    def _places(self) -> DataFrame:
        """Windows that may lie in a span of two different texts: cid, id, places.

        Their hash stands in two texts, and so does one of them with half of what it lacks to a span on either side.
        """
        hits = self.hits[0]
        for h in self.hits[1:]:
            hits = hits.unionAll(h)
        hits = materialise(_once(hits), "places")
        sides = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("side"), F.col(c).alias("h"))) for i, c in enumerate(("left", "right"))]))
        each = hits.select("print", "cid", "place", "id", F.explode(sides).alias("k")).select("print", "cid", "place", "id", "k.side", "k.h")
        many = each.groupBy("print", "side", "h").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a != b").select("print", "side", "h")
        return each.join(many, ["print", "side", "h"], "left_semi").groupBy("cid", "id").agg(F.collect_set("place").alias("places"))

    def _at_places(self, texts: DataFrame) -> DataFrame:
        return texts.join(self._places(), ["id", "cid"]).select("cid", "text", "places")

    def links(self, texts: DataFrame) -> DataFrame:
        """Pairs of different texts with a common span: cid_1 < cid_2, once each."""
        gram, reach = self.gram, self.span - self.gram
        half = (reach + 1) // 2

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    text, places = r["text"], r["places"]
                    left = [text[max(0, p - reach) : p] for p in places]
                    right = [text[p : p + self_span] for p in places]
                    yield pa.RecordBatch.from_arrays([pa.array([r["cid"]] * len(places), pa.binary()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["cid", "before", "after"])

        self_span = self.span
        ctx = self._at_places(texts).mapInArrow(around, "cid binary, before string, after string")
        # of the characters missing to a span, at least half stand on one side: the gram with that half is the key
        keys = F.array_compact(F.array(
            F.when(F.length("before") >= half, F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring(F.col("before"), -half, half), F.substring(F.col("after"), 1, gram)).alias("h"))),
            F.when(F.length("after") >= gram + half, F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring(F.col("after"), 1, gram + half)).alias("h"))),
        ))
        ctx = materialise(ctx.select(F.explode(keys).alias("key"), "cid", "before", "after").select("key.side", "key.h", "cid", "before", "after"), "around")
        other = ctx.select("side", "h", F.col("cid").alias("cid_2"), F.col("before").alias("before_2"), F.col("after").alias("after_2"))
        span = self.span

        @F.pandas_udf("boolean")
        def shares(b1: pd.Series, a1: pd.Series, b2: pd.Series, a2: pd.Series) -> pd.Series:
            return pd.Series([common_prefix(x2, y2) + common_prefix(x1[::-1], y1[::-1]) >= span and x2[:gram] == y2[:gram] for x1, x2, y1, y2 in zip(b1, a1, b2, a2)], dtype=bool)

        both = ctx.join(other, ["side", "h"]).where(F.col("cid") < F.col("cid_2"))
        return both.where(shares("before", "after", "before_2", "after_2")).select(F.col("cid").alias("cid_1"), "cid_2").distinct()

    def covered(self, texts: DataFrame) -> DataFrame:
        """How many characters of each text lie in spans that another text has too: cid, chars."""
        gram, span, reach = self.gram, self.span, self.span - self.gram

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    cp = codes(r["text"])
                    spread = [(p, p) for p in r["places"]] + periodic_runs(cp, sorted(r["places"]), gram)
                    starts = np.unique(np.concatenate([np.arange(max(0, a - reach), min(b, len(cp) - span) + 1) for a, b in spread] or [np.zeros(0, np.int64)])).astype(np.int64)
                    h, g = gram_hashes(cp, span)[starts], gram_hashes(cp ^ np.uint32(0x5A5), span)[starts]
                    yield pa.RecordBatch.from_arrays([pa.array([r["cid"]] * len(starts), pa.binary()), pa.array(starts, pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=["cid", "start", "h", "g"])

        w = materialise(self._at_places(texts).mapInArrow(windows, "cid binary, start int, h bigint, g bigint"), "windows")
        shared = w.groupBy("h", "g").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a != b").select("h", "g")
        # the union of intervals of one length: each adds what the one before leaves
        gap = F.lead("start").over(Window.partitionBy("cid").orderBy("start")) - F.col("start")
        return w.join(shared, ["h", "g"], "left_semi").select("cid", F.least(F.coalesce(gap, F.lit(span)), F.lit(span)).alias("adds")).groupBy("cid").agg(F.sum("adds").alias("chars"))


def common_prefix(a: str, b: str) -> int:
    """How many first characters are equal."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def span_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, span: int = SPAN, batches: int = BATCHES) -> DataFrame:
    """Pairs of documents whose texts have ``span`` consecutive characters in common, every character equal: ``id_col``_1 < ``id_col``_2, once each.

    Different texts are compared once however many documents have them; documents of equal text (of ``span`` characters at least) are pairs too.
    Null, empty and shorter texts share nothing; rows without an id are left out; rows of one id are one document.
    """
    texts = _texts(docs, id_col, text_col, span)
    index = FingerprintIndex(docs.sparkSession, gram, span)
    index.add_in_batches(texts, batches)
    links = materialise(index.links(texts), "links")
    members = texts.select("cid", "id").distinct()
    one, two = members.select(F.col("cid").alias("cid_1"), F.col("id").alias("i")), members.select(F.col("cid").alias("cid_2"), F.col("id").alias("j"))
    between = links.join(one, "cid_1").join(two, "cid_2").select("i", "j")
    classes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cid")
    same = members.join(classes, "cid").select("cid", F.col("id").alias("i"))
    within = same.join(same.select("cid", F.col("i").alias("j")), "cid").where("i < j").select("i", "j")
    pair = between.unionAll(within).where("i != j")
    return pair.select(F.least("i", "j").alias(f"{id_col}_1"), F.greatest("i", "j").alias(f"{id_col}_2")).distinct()


def span_shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, span: int = SPAN, batches: int = BATCHES) -> DataFrame:
    """For each row of ``docs``: ``id_col``, chars, copies (documents of the same text, itself included), shared_chars and share.

    shared_chars counts the characters that lie in spans of at least ``span`` characters which another document has too.
    Null, empty and shorter texts share nothing (copies 1, share 0); a row without an id shares nothing.
    """
    texts = _texts(docs, id_col, text_col, span)
    index = FingerprintIndex(docs.sparkSession, gram, span)
    index.add_in_batches(texts, batches)
    chars = index.covered(texts)
    copies = texts.groupBy("cid").agg(F.count_distinct("id").alias("copies"))
    per = copies.join(chars, "cid", "left").where("copies > 1 or chars is not null")
    rows = docs.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"), F.when((F.length(text_col) >= span) & F.col(id_col).isNotNull(), F.unhex(F.md5(text_col))).alias("cid"))
    got = rows.join(per.withColumnRenamed("chars", "shared"), "cid", "left")
    shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce(F.col("shared"), F.lit(0))).cast("long")
    return got.select(id_col, "chars", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), shared.alias("shared_chars"), F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(F.lit(0.0)).alias("share"))
