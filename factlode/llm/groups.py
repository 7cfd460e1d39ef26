"""Splits that keep related records together: components of shared keys, balanced bins, whole bins per split."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factlode.operators.prefix import running_sums
from factlode.runtime import materialise

#: Bins that groups are balanced into, and the packs that light groups are dealt into; balancing takes twice as many items on the driver at most.
BINS, PACKS = 100, 4096
SEED = 20260731


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: each node with the least node that they tie it to."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    stars = [(x, find(x)) for x in list(root)]
    stars = [(x, r) for x, r in stars if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.string()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Of ``links`` (a, b: strings) the least node of each node's component: node, root.

    The links of a partition are contracted where they lie, to one link from each node to the least that they tie it to.  Then large-star and
    small-star steps by turns: every node points its greater neighbours, then all its neighbours, at the least node near it,
    until nothing changes; the number of rounds grows with the logarithm of the largest component.  Each step is a
    grouping of distinct links whose lineage is cut in the shared folder.
    """
    both = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = materialise(both.where("u != v").mapInArrow(_contract, "u string, v string").distinct(), "stars")

    def least_near(edges: DataFrame) -> DataFrame:
        m = edges.groupBy("x").agg(F.min("y").alias("m"))
        return edges.join(m.select("x", F.least("x", "m").alias("m")), "x")

    while True:
        two_way = stars.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(stars.select(F.col("v").alias("x"), F.col("u").alias("y")))
        large = least_near(two_way).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        small_in = large.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        near = least_near(small_in)
        small = near.select(F.col("y").alias("u"), F.col("m").alias("v")).unionAll(near.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        new = materialise(small, "stars")
        # links are distinct, so as many links of which none is new are the same links
        same = stars.count() == new.count() and new.join(stars, ["u", "v"], "left_anti").isEmpty()
        stars = new
        if same:
            break
    return nodes.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def balance(weights: dict[str, int], bins: int) -> list[tuple[int, list[str]]]:
    """Items in ``bins`` bins of nearly equal weight, by largest differencing: the two partial solutions of widest spread are
    combined, the heaviest bin of one with the lightest of the other, until one is left."""
    order = itertools.count()
    heap = []
    for name, w in sorted(weights.items()):
        heap.append((-w, next(order), [(w, [name])]))  # bins that hold nothing are left out
    heapq.heapify(heap)
    if not heap:
        return []
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a = sorted(a, key=lambda x: -x[0])
        b = sorted(b, key=lambda x: -x[0])
        room = bins - len(a)
        merged = a + b[:room] if len(a) + len(b) <= bins else None
        if merged is None:
            # heaviest of one meets lightest of the other; empty bins stand at the light ends
            a_full, b_full = a + [(0, [])] * room, b + [(0, [])] * (bins - len(b))
            merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a_full, reversed(b_full))]
        full = [x for x in merged if x[1]]
        lightest = min(x[0] for x in full) if len(full) == bins else 0
        heapq.heappush(heap, (-(max(x[0] for x in full) - lightest), next(order), full))
    return heap[0][2]


def allocate(bins: list[tuple[int, list[str]]], shares: dict[str, float]) -> dict[str, str]:
    """The split of each item: bins from the heaviest, each to the split that lacks most of its share."""
    total = sum(w for w, _ in bins)
    lack = {s: share * total for s, share in sorted(shares.items()) if share > 0}
    out = {}
    for w, names in sorted(bins, key=lambda x: (-x[0], x[1])):
        s = max(lack, key=lambda s: (lack[s], s))
        lack[s] -= w
        out |= dict.fromkeys(names, s)
    return out


def grouped(records: DataFrame, id_col: str, keys: Column) -> DataFrame:
    """Distinct records with the least key of the group that their keys tie them to: id, group_key, group_size (keys in it).

    keys: an array of strings of each record; null keys tie nothing.  A record without keys has null and 0.
    """
    r = records.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNotNull()))).alias("keys"))
    per = r.where("id is not null").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys"))
    per = materialise(per, "keys")
    links = per.where("size(keys) > 0").select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct()
    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"))
    found = roots.join(sizes, "root").select(F.col("node").alias("first"), F.col("root").alias("group_key"), "group_size")
    return per.withColumn("first", F.get("keys", F.lit(0))).join(found, "first", "left").select("id", "group_key", F.coalesce("group_size", F.lit(0)).alias("group_size"))


def grouped_splits(records: DataFrame, targets: DataFrame, id_col: str, keys: Column, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """A split for each distinct record such that records tied by ``keys``, directly or through others, share it: ``id_col``, split_name, group_key.

    targets: split_name, share; a row without a name or a positive share takes nothing, and shares need not sum to 1.

    Groups are weighed by their distinct records.  Those that weigh a pack's share or more are items of their own, the others are dealt in the
    order of their weight, one to each of PACKS packs by turns, so that packs differ by no more than the heaviest of them; with no more light
    groups than packs each has its own.  Records without keys, of weight 1 each, join packs by hash.  So at most 2 x PACKS weights reach the driver;
    largest differencing puts them into ``bins`` bins, and whole bins go to the splits.  Records without an id are left out; repeated rows count
    once.  More than PACKS targets are refused.
    A group larger than a split's share stays whole, and the shares reached differ by that much.
    """
    g = materialise(grouped(records, id_col, keys), "grouped")
    weight = g.where("group_key is not null").groupBy("group_key").agg(F.count(F.lit(1)).alias("w"))
    total = g.count()
    pack = lambda n: F.concat(F.lit("pack:"), F.pmod(n, F.lit(PACKS)).cast("string"))
    heavy = F.col("w") * PACKS >= total
    light = running_sums(weight.where(~heavy).select("group_key", (-F.col("w")).alias("order"), F.lit(1).alias("one"), F.lit(0).alias("all")), ["all"], ["order", "group_key"], {"place": "one"})
    named = weight.where(heavy).select("group_key", F.concat(F.lit("own:"), "group_key").alias("item")).unionAll(light.select("group_key", pack(F.col("place"))))
    items = g.join(named, "group_key", "left").withColumn("item", F.coalesce("item", pack(F.xxhash64("id", F.lit(seed)))))
    items = materialise(items, "items")
    weights = {r["item"]: r["n"] for r in items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * PACKS
    named_targets = targets.select("split_name", "share").where("split_name is not null and share > 0").limit(PACKS + 1).collect()
    if len(named_targets) > PACKS:
        raise ValueError(f"more than {PACKS} targets")
    wanted = {r["split_name"]: float(r["share"]) for r in named_targets}
    schema = "item string, split_name string"
    chosen = allocate(balance(weights, bins), wanted) if wanted else {}
    where = items.sparkSession.createDataFrame(sorted(chosen.items()), schema)
    return items.join(F.broadcast(where), "item", "left").select(F.col("id").alias(id_col), "split_name", "group_key")
