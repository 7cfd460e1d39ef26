"""Exact set-similarity join on character bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factlode.functions.text import gram_set
from factlode.runtime import materialise, width

#: Bigrams whose counts steer the order of all; words of 64 bits of a sketch.
STEERED, WORDS = 20_000, 2


def similar_texts(rows: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Texts whose bigram sets have a Jaccard similarity of at least ``threshold``: (pairs, members).

    members: id and class; rows of equal bigram sets are one class (its least id).  pairs: class_1 < class_2, similarity, between
    different sets only; copies are not spread out.  Each set offers its rarest bigrams, as many as a similar one must meet (prefix filter; the smaller of
    two sets needs fewer).  Where two meet, a sketch that never overstates how far they differ decides whether they are compared, before
    anything is shuffled; so common bigrams cost no disk and no pair is lost.  Null and empty texts are in no class.
    """
    r = rows.select(F.col(id_col).alias("id"), F.array_sort(gram_set(F.col(text_col))).alias("grams")).where("id is not null and size(grams) > 0")
    r = r.select("id", _numbers(F.col("grams")).alias("grams"), F.unhex(F.md5(F.array_join("grams", "\x01"))).alias("key"))
    classes = r.groupBy("key").agg(F.min("id").alias("class"))
    members = r.select("id", "key").distinct().join(classes, "key").select("id", "class")
    # one row carries the set of its class: the first of any, as they are equal
    sets = materialise(r.repartition(width(rows.sparkSession), "key").groupBy("key").agg(F.min("id").alias("class"), F.first("grams").alias("grams")).select("class", "grams"), "sets")
    often = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    steered = often.orderBy(F.desc("often"), "gram").limit(STEERED).toArrow()
    kind = sets.schema["class"].dataType.simpleString()
    sketch = ", ".join(f"s{i} long" for i in range(WORDS))
    offered = sets.mapInArrow(_offers(steered.column("gram").to_numpy(), steered.column("often").to_numpy(), threshold), f"gram long, class {kind}, n int, short boolean, {sketch}")
    a = offered.where("short").select("gram", F.col("class").alias("a"), F.col("n").alias("n_a"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(WORDS)])
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"s{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("s0"))))
    n = F.col("n_a") + F.col("n")
    smaller = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("a") < F.col("class")))
    near = smaller & (F.col("n_a") >= F.col("n") * threshold - 1e-6) & (apart * (1 + threshold) <= n * (1 - threshold) + 1e-6)
    # few are left; written, so that their number is known and the sets need not be shuffled for them
    cand = materialise(a.join(offered, "gram").where(near).select(F.least("a", "class").alias("class_1"), F.greatest("a", "class").alias("class_2")).distinct(), "candidates")
    full = lambda i: sets.select(F.col("class").alias(f"class_{i}"), F.col("grams").alias(f"g{i}"))
    both = F.size(F.array_intersect("g1", "g2"))
    pairs = cand.join(full(1), "class_1").join(full(2), "class_2").select("class_1", "class_2", (both / (F.size("g1") + F.size("g2") - both)).alias("exact"))
    return pairs.where(F.col("exact") >= threshold).select("class_1", "class_2", F.round("exact", 3).alias("similarity")), members


def _numbers(grams: Column) -> Column:
    """Each bigram as one number, no two alike: its first character, and the second plus one (none is 0)."""
    return F.transform(grams, lambda g: F.ascii(g).cast("long") * (1 << 22) + F.when(F.length(g) > 1, F.ascii(F.substring(g, 2, 1)) + 1).otherwise(0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _offers(steered: np.ndarray, often: np.ndarray, threshold: float):
    """class, grams -> a row for each bigram that the set offers: rare ones first, those beyond ``steered`` as if never seen.

    The order only has to be the same for all sets.  short: what it offers to sets that are no smaller.  s0...: bits that are set where an odd number of
    its bigrams fall, so that two sets differ in at least as many bigrams as in bits.
    """
    by = np.argsort(steered)
    steered, often = steered[by], often[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("grams")
            gram, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            if not len(gram):
                continue
            owner, mixed = np.repeat(np.arange(len(n)), n), _mixed(gram)
            at = np.minimum(np.searchsorted(steered, gram), len(steered) - 1)
            count = np.where(steered[at] == gram, often[at], 0)
            order = np.lexsort((mixed, count, owner))
            place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
            long = n - np.ceil(n * threshold - 1e-6).astype(np.int64) + 1
            short = n - np.ceil(n * (2 * threshold / (1 + threshold)) - 1e-6).astype(np.int64) + 1
            kept = place < long[owner]
            of, first = owner[kept], place[kept] < short[owner[kept]]
            bit = (mixed % np.uint64(64 * WORDS)).astype(np.int64)
            odd = np.bincount(owner * 64 * WORDS + bit, minlength=len(n) * 64 * WORDS).astype(np.uint8) & 1
            sketch = np.packbits(odd.reshape(len(n), WORDS, 64), axis=2, bitorder="little").view(np.int64).reshape(len(n), WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[order][kept]), b.column("class").take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(first), *[pa.array(sketch[of, i]) for i in range(WORDS)]],
                names=["gram", "class", "n", "short", *[f"s{i}" for i in range(WORDS)]],
            )

    return run
