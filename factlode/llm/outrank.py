"""One ranking from scores of different scales: outranking by percentiles and net flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factlode.operators.prefix import HOT_ROWS, running_sums
from factlode.runtime import materialise, width

#: Differences of percentile up to which neither item is preferred, and from which one is preferred fully.
INDIFFERENT, FULL = 0.05, 0.5


def _positive(v, q, s, c_q, m_q, c_s, m_s):
    """Summed preference over items below: v the item's own value, counts and sums of values up to v - q and v - s."""
    return c_s + ((v - q) * (c_q - c_s) - (m_q - m_s)) / (s - q)


def _ordinal(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Whole numbers in the order of the values (-1: null), and the values in that order."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), column.slice(0, 0)
    d = column.dictionary_encode()
    order = pc.sort_indices(d.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at < 0, -1, place[at] if len(order) else -1), d.dictionary.take(order)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def rank_groups(g: np.ndarray, i: np.ndarray, r: np.ndarray, x: np.ndarray, t: np.ndarray, weight: np.ndarray, indifferent: float, full: float) -> tuple[np.ndarray, ...]:
    """Whole groups ranked: group, item, rank, flow and number of scores of each item, in order of group and rank.

    g, i, r: groups, items and sources as whole numbers in their order; x: scores; t: times; weight: of each source.
    Sorted once by group and source, all preferences come from running counts and sums of doubled ranks.
    """
    finite = np.isfinite(x)
    by = np.lexsort((np.where(finite, x, 0.0), t, finite, r, i, g))
    last = np.append(_starts(g[by], i[by], r[by])[1:], True)
    g, i, r, x, finite = (a[by][last] for a in (g, i, r, x, finite))
    item = np.cumsum(_starts(g, i)) - 1  # items by number; (g, i, r) are in order
    of = np.flatnonzero(_starts(g, i))
    item_g, item_i = g[of], i[of]
    n_scores = np.bincount(item, finite, len(of)).astype(np.int64)
    group = np.cumsum(_starts(item_g)) - 1
    n_of = np.bincount(group)
    at = np.flatnonzero(finite)
    at = at[np.lexsort((x[at], r[at], g[at]))]
    gr, rr, xx, it = group[item[at]], r[at], x[at] + 0.0, item[at]
    block = np.cumsum(_starts(gr, rr)) - 1
    level = np.cumsum(_starts(gr, rr, xx)) - 1
    first = np.flatnonzero(_starts(gr, rr))
    n_blocks, b_group = len(first), gr[first]
    base, gain, w_all = np.zeros(len(n_of)), np.zeros(len(of)), np.zeros(len(n_of))
    if n_blocks:
        scored = np.bincount(block)
        n, missing = n_of[b_group], n_of[b_group] - scored
        k = np.bincount(level)
        head = np.flatnonzero(_starts(level))
        b = block[head]
        # ranks doubled to be whole: the middle of a run of k equal ones behind `lower` others is 2 * lower + k + 1
        v = 2 * (missing[b] + head - first[b]) + k + 1
        gone = np.flatnonzero(missing > 0)
        b_all, k_all, v_all = np.concatenate([gone, b]), np.concatenate([missing[gone], k]), np.concatenate([missing[gone] + 1, v])
        order = np.lexsort((v_all, b_all))
        b_all, k_all, v_all = b_all[order], k_all[order], v_all[order]
        counts, sums = (np.concatenate([[0], np.cumsum(c)]) for c in (k_all, k_all * v_all))
        begin = np.searchsorted(b_all, np.arange(n_blocks))
        nb = n[b_all].astype(float)
        wide = 4.0 * float(nb.max() * max(full, 1.0)) + 4  # blocks so far apart that none reaches into the next
        place = b_all * wide + v_all
        q, s = nb * (2 * indifferent), nb * (2 * full)

        def upto(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            end = np.maximum(np.searchsorted(place, b_all * wide + value, "right"), begin[b_all])
            return (counts[end] - counts[begin[b_all]]).astype(float), (sums[end] - sums[begin[b_all]]).astype(float)

        (c1, m1), (c2, m2), (c3, m3), (c4, m4) = (upto(y) for y in (v_all - s, v_all - q, v_all + q, v_all + s))
        all_m = nb * (nb + 1.0)  # all doubled ranks together
        down = _positive(v_all, q, s, c2, m2, c1, m1)
        # from above: mirror the values, so that what lies beyond v + q lies below
        up = (nb - c4) + ((all_m - m3) - (all_m - m4) - (v_all + q) * (c4 - c3)) / (s - q)
        flow_all = np.where(nb > 1, (down - up) / np.maximum(nb - 1, 1), 0.0)
        flow = np.empty(len(order))
        flow[order] = flow_all
        w = weight[rr[first]]
        absent = np.zeros(n_blocks)
        absent[gone] = flow[: len(gone)]
        w_all, base = np.bincount(b_group, w, len(n_of)), np.bincount(b_group, w * absent, len(n_of))
        gain = np.bincount(it, w[block] * (flow[len(gone) :][level] - absent[block]), len(of))
    phi = np.round((base[group] + gain) / np.where(w_all > 0, w_all, 1.0)[group], 9) + 0.0
    order = np.lexsort((item_i, -phi, group))
    begins = np.flatnonzero(_starts(group[order]))
    rank = np.arange(len(order)) - begins[group[order]] + 1
    return item_g[order], item_i[order], rank, phi[order], n_scores[order]


def _ranker(named: dict[str, float], indifferent: float, full: float):
    """Ranks groups whose rows follow each other, whatever the batches."""

    def ranked(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).combine_chunks()
        (g, groups), (i, items), (r, sources), (at, _) = (_ordinal(col(c)) for c in "girt")
        weight = np.array([named.get(s, 1.0) for s in sources.to_pylist()], float)
        x = col("x").to_numpy(zero_copy_only=False).astype(float)
        g, i, rank, phi, n = rank_groups(g, i, r, x, at, weight, indifferent, full)
        return pa.RecordBatch.from_arrays([groups.take(pa.array(g)), pa.array(rank, pa.int32()), items.take(pa.array(i)), pa.array(phi), pa.array(n, pa.int64())], names=["g", "rank", "i", "phi", "n_scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 50_000:
                continue
            key = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(key[1:] != key[:-1])
            if len(cuts):
                cut = int(cuts[-1]) + 1
                yield ranked(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
                held, rows = [batch.slice(cut)], batch.num_rows - cut
        if rows:
            yield ranked(pa.Table.from_batches(held))

    return run


def net_flow_ranking(hits: DataFrame, group: str = "question_id", item: str = "chunk_id", source: str = "retriever", score: str = "score", at: str = "run_at", weights: dict[str, float] | None = None, indifferent: float = INDIFFERENT, full: float = FULL, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each item of a group once, ranked by what all its scores together prefer: ``group``, rank, ``item``, net_flow, n_scores.

    Of an item's records by one source the latest with a finite score counts (of equally late ones the highest score).  A score
    becomes its percentile among all items of the group, ties sharing the middle; an item that a source did not return, or without
    a finite score, stands below all that it scored.  A source prefers an item to another by 0 up to ``indifferent`` of percentile, by 1 from ``full``
    on, linearly between.  An item's flow is its mean preference over the others less theirs over it, summed over the
    sources by ``weights`` (each 1 if not named; divided by their sum), so no source weighs more by the size of its numbers.  The sums over all
    pairs come exactly from running counts and sums of whole-number ranks; no pair is formed.  Whole groups meet in one exchange; those of more than
    ``hot_rows`` rows are ranked by the same sums over ranges of their order.

    Rank 1 is the greatest flow; equal flows (to nine places) go by item.  Records without group, item or source are left out; a group with
    one item has flow 0; items none of whose scores is finite are ranked with flow by absence.  Empty: empty.
    """
    if not 0 <= indifferent < full:
        raise ValueError("indifference must end below full preference")
    h = hits.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(source).alias("r"), F.col(score).cast("double").alias("x"), F.col(at).alias("t"))
    h = h.where("g is not null and i is not null and r is not null")
    named = weights or {}
    hot = materialise(h.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("g"), "hot")
    some_hot = not hot.isEmpty()
    usual = h.join(hot, "g", "left_anti") if some_hot else h
    kinds = {f.name: f.dataType.simpleString() for f in h.schema}
    out = usual.repartition(width(h.sparkSession), "g").sortWithinPartitions("g").mapInArrow(_ranker(named, indifferent, full), f"g {kinds['g']}, rank int, i {kinds['i']}, phi double, n_scores bigint")
    if some_hot:
        out = out.unionByName(_cut_ranking(h.join(hot, "g", "left_semi"), named, indifferent, full, hot_rows))
    return out.select(F.col("g").alias(group), "rank", F.col("i").alias(item), F.col("phi").alias("net_flow"), "n_scores")


def _cut_ranking(h: DataFrame, named: dict[str, float], indifferent: float, full: float, hot_rows: int) -> DataFrame:
    """Groups too large for one task: every count and sum comes from ranges of the order (g, i, r, x, t in; g, rank, i, phi, n_scores out)."""
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))
    best = h.groupBy("g", "i", "r").agg(F.max_by(F.when(finite, F.col("x")), F.when(finite, F.struct(F.coalesce(F.col("t").cast("string"), F.lit("")), "x"))).alias("x"))
    best = materialise(best.withColumn("x", F.col("x") + F.lit(0.0)), "best")  # -0.0 is 0.0
    items = best.groupBy("g", "i").agg(F.count("x").alias("n_scores"))
    n_items = items.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    weight = F.coalesce(F.create_map(*[F.lit(v) for kv in named.items() for v in kv])[F.col("r")], F.lit(1.0)) if named else F.lit(1.0)
    levels = best.where("x is not null").groupBy("g", "r", "x").agg(F.count(F.lit(1)).alias("k"))
    lowest = levels.groupBy("g", "r").agg(F.sum("k").alias("scored")).join(n_items, "g")
    levels = running_sums(levels, ["g", "r"], ["x"], {"lower": "k"}, hot_rows, upto=False).join(lowest, ["g", "r"])
    # ranks doubled to be whole: the middle of a run of k equal ones behind `lower` others is 2 * lower + k + 1
    missing = F.col("n") - F.col("scored")
    data = levels.select("g", "r", "n", F.col("x"), "k", (2 * (missing + F.col("lower")) + F.col("k") + 1).alias("v"))
    data = materialise(data.unionAll(lowest.where(missing > 0).select("g", "r", "n", F.lit(None).cast("double").alias("x"), missing.alias("k"), (missing + 1).alias("v"))), "levels")
    q, s = F.col("n") * (2 * indifferent), F.col("n") * (2 * full)
    v = F.col("v").cast("double")
    own = F.struct(v.alias("at"), F.lit(0).alias("what"), F.col("k").alias("c"), (F.col("k") * F.col("v")).alias("m"))
    probe = lambda what, where: F.struct(where.alias("at"), F.lit(what).alias("what"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("m"))
    points = data.select("g", "r", "v", F.inline(F.array(own, probe(1, v - s), probe(2, v - q), probe(3, v + q), probe(4, v + s))))
    summed = running_sums(points, ["g", "r"], ["at", "what", "v"], {"c_to": "c", "m_to": "m"}, hot_rows)
    pick = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c))).cast("double").alias(f"{c}{what}")
    around = summed.where("what > 0").groupBy("g", "r", "v").agg(*[pick(w, c) for w in (1, 2, 3, 4) for c in ("c_to", "m_to")])
    flow = data.join(around, ["g", "r", "v"])
    all_m = F.col("n") * (F.col("n") + 1.0)  # all doubled ranks together
    down = _positive(v, q, s, F.col("c_to2"), F.col("m_to2"), F.col("c_to1"), F.col("m_to1"))
    # from above: mirror the values, so that what lies beyond v + q lies below
    up_q, up_s = F.col("n") - F.col("c_to3"), F.col("n") - F.col("c_to4")
    up = up_s + ((all_m - F.col("m_to3")) - (all_m - F.col("m_to4")) - (v + q) * (up_q - up_s)) / (s - q)
    flow = flow.withColumn("w", weight).select("g", "r", "x", "w", F.when(F.col("n") > 1, (down - up) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("f"))
    flow = materialise(flow, "flow")
    absent = flow.where("x is null").select("g", "r", F.col("f").alias("base"))
    base = flow.select("g", "r", "w").distinct().join(absent, ["g", "r"], "left").groupBy("g").agg(F.sum("w").alias("w_all"), F.sum(F.col("w") * F.coalesce("base", F.lit(0.0))).alias("base"))
    gain = best.where("x is not null").join(flow.where("x is not null"), ["g", "r", "x"]).join(absent, ["g", "r"], "left").groupBy("g", "i").agg(F.sum(F.col("w") * (F.col("f") - F.coalesce("base", F.lit(0.0)))).alias("gain"))
    total = items.join(base, "g", "left").join(gain, ["g", "i"], "left")
    phi = F.round((F.coalesce("base", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))) / F.coalesce("w_all", F.lit(1.0)), 9) + F.lit(0.0)
    scored = total.select("g", "i", "n_scores", phi.alias("phi"), (-phi).alias("down"), F.lit(1).alias("one"))
    ranked = running_sums(scored, ["g"], ["down", "i"], {"rank": "one"}, hot_rows)
    return ranked.select("g", F.col("rank").cast("int").alias("rank"), "i", "phi", "n_scores")
