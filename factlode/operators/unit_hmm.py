"""Figures in common units: a hidden Markov model of each series with the unit's scale as its state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factlode.functions.keys import fold_width
from factlode.functions.unit_text import MONEY, PER_SHARE, RATIO, SHARES, recorded
from factlode.operators.prefix import running_sums
from factlode.runtime import materialise

#: Scales a figure can be in, and the kinds of figures.
SCALES = np.array([1, 10**3, 10**4, 10**6, 10**7, 10**8, 10**9], np.int64)
KINDS = [MONEY, SHARES, PER_SHARE, RATIO]
_LOG = np.log10(SCALES.astype(float))
#: Classes of printed decimals: none, up to two, up to four, more.
DECIMALS = 4
#: Recorded figures on either side that make up the level of a row, and as how many the level of all series counts among them.
AROUND, PSEUDO = 16, 8.0
#: Rows (of whole series, picked by hash) that the model is fitted on.
FIT_ROWS = 50_000
#: Rows of a series beyond which it is decoded in blocks, and rows of a block.
HOT_ROWS, BLOCK = 500_000, 100_000
_NEVER = 1e12


class Model(NamedTuple):
    """Costs (negative logarithms): start (kind, scale), move (kind, whether the same figure stands before, scale, scale),
    decimals (kind, scale, class); the level of each kind and its spread, and what accounts' levels add up to."""

    start: np.ndarray
    move: np.ndarray
    decimals: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    accounts: dict[tuple[str, int], tuple[float, int]]

    def usual(self, account: str | None, kind: int) -> float:
        total, n = self.accounts.get((account, kind), (0.0, 0))
        return (total + PSEUDO * self.mean[kind]) / (n + PSEUDO)


def fit(series: np.ndarray, kind: np.ndarray, account: list, value: np.ndarray, level: np.ndarray, decimals: np.ndarray, stated: np.ndarray) -> Model:
    """The model of rows in order of series and time, from those whose scale is recorded (stated: index of SCALES, else -1)."""
    k, kinds = len(SCALES), len(KINDS)
    known = stated >= 0
    count = lambda shape, *at: np.bincount(np.ravel_multi_index(at, shape), minlength=int(np.prod(shape))).reshape(shape).astype(float)
    often = count((kinds, k), kind[known], stated[known]) + 0.5
    start = often / often.sum(1, keepdims=True)
    figure = known & ~np.isnan(level)
    printed = count((kinds, k, DECIMALS), kind[figure], stated[figure], decimals[figure])
    overall = (printed.sum(1, keepdims=True) + 0.5) / (printed.sum((1, 2), keepdims=True) + 0.5 * DECIMALS)
    printed = (printed + overall) / (printed.sum(2, keepdims=True) + 1.0)
    next_to = known[1:] & known[:-1] & (series[1:] == series[:-1]) if len(known) else known
    same = (value[1:] == value[:-1]) & ~np.isnan(level[1:]) if len(known) else known
    at = np.flatnonzero(next_to)
    moved = count((kinds, 2, k, k), kind[at], same[at].astype(int), stated[at], stated[at + 1])
    moved = (moved + start[:, None, None, :]) / (moved.sum(3, keepdims=True) + 1.0)
    base = level + np.where(known, _LOG[stated], np.nan)
    mean, spread, accounts = np.full(kinds, 6.0), np.full(kinds, 2.0), {}
    for i in range(kinds):
        if (b := base[figure & (kind == i)]).size > 1:
            mean[i], spread[i] = b.mean(), max(float(b.std()), 0.05)
    if figure.any():
        sums = pd.DataFrame({"a": np.array(account, object)[figure], "k": kind[figure], "b": base[figure]}).groupby(["a", "k"]).b.agg(["sum", "size"])
        accounts = {key: (float(s), int(n)) for key, s, n in zip(sums.index, sums["sum"], sums["size"])}
    return Model(-np.log(start), -np.log(moved), -np.log(printed), mean, spread, accounts)


def levels(level: np.ndarray, stated: np.ndarray, series: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The smooth level beneath each row: the mean of the recorded amounts (log10) up to AROUND rows away in its series, drawn to ``usual``."""
    n = len(level)
    first = np.flatnonzero(np.append(True, series[1:] != series[:-1]))
    run = np.cumsum(np.append(True, series[1:] != series[:-1])) - 1
    begin, end = first[run], np.append(first[1:], n)[run]
    have = (stated >= 0) & ~np.isnan(level)
    sums = np.concatenate([[0.0], np.cumsum(np.where(have, level + _LOG[stated] - usual, 0.0))])
    held = np.concatenate([[0], np.cumsum(have)])
    lo, hi = np.maximum(begin, np.arange(n) - AROUND), np.minimum(end, np.arange(n) + AROUND + 1)
    return usual + (sums[hi] - sums[lo]) / (held[hi] - held[lo] + PSEUDO)


def emissions(model: Model, level: np.ndarray, decimals: np.ndarray, kind: np.ndarray, smooth: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """What each scale costs at each row: the jump from the smooth level and the decimals as printed; a recorded scale is certain."""
    z = (level[:, None] + _LOG - smooth[:, None]) / model.spread[kind][:, None]
    cost = np.where(np.isnan(z), 0.0, 0.5 * z * z + model.decimals[kind, :, decimals])
    at = np.flatnonzero(stated >= 0)
    cost[at] = _NEVER
    cost[at, stated[at]] = 0.0
    return cost


def viterbi(model: Model, cost: np.ndarray, stated: np.ndarray, series: np.ndarray, kind: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The likeliest scale of each row, as an index of SCALES.

    cost: emissions; stated: the index of the recorded scale, -1 where none; rows of one series follow each other in order of time;
    same: whether the row before has the same figure.

    Rows with a recorded scale cut a series into runs that do not depend on each other, and all runs are decoded at once, step by step.
    """
    n, out = len(stated), stated.astype(np.int64)
    if not n or (stated >= 0).all():
        return out
    first = np.append(True, series[1:] != series[:-1])
    last = np.append(first[1:], True)
    open_row = stated < 0
    begin = np.flatnonzero(open_row & (first | ~np.append(False, open_row[:-1])))
    end = np.flatnonzero(open_row & (last | ~np.append(open_row[1:], False)))
    size = end - begin + 1
    order = np.argsort(-size, kind="stable")
    begin, end, size = begin[order], end[order], size[order]
    move = lambda rows: model.move[kind[rows], same[rows].astype(int)]  # noqa: E731  from the row before
    from_left = move(begin)[np.arange(len(begin)), np.maximum(stated[np.maximum(begin - 1, 0)], 0)]
    paid = np.where(first[begin][:, None], model.start[kind[begin]], from_left) + cost[begin]
    back: list[np.ndarray] = []
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
        row = begin[:live] + t
        total = paid[:live, :, None] + move(row)
        back.append(total.argmin(1))
        paid[:live] = total.min(1) + cost[row]
    right = np.minimum(end + 1, n - 1)
    to_right = move(right)[np.arange(len(end)), :, np.maximum(stated[right], 0)]
    state = (paid + np.where(last[end][:, None], 0.0, to_right)).argmin(1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        out[begin[:live] + t] = state[:live]
        if t:
            state[:live] = back[t - 1][np.arange(live), state[:live]]
    return out


def passage(model: Model, cost: np.ndarray, stated: np.ndarray, kind: int, same: np.ndarray, begins: bool) -> np.ndarray:
    """What the cheapest path through all rows costs from each scale before them to each at the last one, but for a constant.

    begins: no row stands before, so all scales before are alike.  Rows between recorded ones do not depend on the ends and are left out.
    """
    known = np.flatnonzero(stated >= 0)
    rows = np.arange(len(stated))
    if len(known) > 1:
        rows = np.concatenate([rows[: known[0] + 1], rows[known[-1] :]])
    k = len(SCALES)
    paid = (np.tile(model.start[kind], (k, 1)) if begins else model.move[kind, int(same[0])]) + cost[0]
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b == a + 1:
            paid = (paid[:, :, None] + model.move[kind, int(same[b])][None]).min(1) + cost[b]
        else:  # between two recorded rows
            paid = paid.min(1)[:, None] + np.where(np.arange(k) == stated[b], 0.0, _NEVER)
    return paid


_PARSED = "account string, kind string, scale bigint, currency string, source string, stated int"


def _read(n_keys: int, names: list[str]):
    """Adds to each row what its texts record; the texts are the last four columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = {int(s): i for i, s in enumerate(SCALES)}
        for batch in batches:
            texts = [batch.column(n_keys + i).dictionary_encode() for i in range(4)]
            code = np.zeros(batch.num_rows, np.int64)
            for t in texts:
                code = code * (len(t.dictionary) + 1) + t.indices.fill_null(len(t.dictionary)).to_numpy(zero_copy_only=False)
            distinct, at, back = np.unique(code, return_index=True, return_inverse=True)
            cols = [t.take(pa.array(at)).to_pylist() for t in texts]
            got = [recorded(*x) for x in zip(*cols)]
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            take = pa.array(back)
            stated = np.array([where.get(g[2], -1) if g[2] else -1 for g in got] or [0], np.int32)
            found = [pa.array([g[i] for g in got], types[i]).take(take) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *found, pa.array(stated[back] if len(got) else np.zeros(0, np.int32))], names=names)

    return run


class _Rows:
    """Columns of rows in order of series and time, as the model takes them."""

    def __init__(self, t: pa.Table, model: Model):
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        self.series, self.level, self.decimals = col("series"), col("level").astype(float), col("decimals")
        self.stated = col("stated").astype(np.int64)
        kinds, accounts = t.column("kind").combine_chunks().dictionary_encode(), t.column("account").combine_chunks().dictionary_encode()
        self.kind = np.array([KINDS.index(x) for x in kinds.dictionary.to_pylist()] or [0], np.int64)[kinds.indices.to_numpy(zero_copy_only=False)]
        names = accounts.dictionary.to_pylist()
        pair = accounts.indices.fill_null(len(names)).to_numpy(zero_copy_only=False) * len(KINDS) + self.kind
        distinct, back = np.unique(pair, return_inverse=True)
        usual = np.array([model.usual([*names, None][p // len(KINDS)], p % len(KINDS)) for p in distinct.tolist()] or [0.0])[back]
        self.same = np.append(False, (self.level[1:] == self.level[:-1]) & (self.series[1:] == self.series[:-1]))
        self.cost = emissions(model, self.level, self.decimals, self.kind, levels(self.level, self.stated, self.series, usual), self.stated)


def _whole_series(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.Table]:
    """Tables of whole series, of rows that come in order of series; a series has at most as many rows as make it hot."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 20_000:
            continue
        key = batch.column(at).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1])
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _decode(model: Model, names: list[str]):
    """Decodes whole series or blocks of them.  own is false of the rows around a block; entry and leave are the scales that were found at
    the row before a block and at its last one, -1 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_series(batches, names.index("series")):
            r = _Rows(t, model)
            own = np.asarray(t.column("own").to_numpy(zero_copy_only=False), bool)
            forced = r.stated
            if not own.all() or t.column("leave").null_count < t.num_rows:
                entry, leave = (t.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("entry", "leave"))
                forced = forced.copy()
                turn = r.series[1:] != r.series[:-1]
                before = np.flatnonzero(np.append(~own[:-1] & own[1:] & ~turn, False))
                forced[before] = entry[before]
                last = np.flatnonzero(own & np.append(turn | ~own[1:], True) & (leave >= 0))
                forced[last] = leave[last]
            states = viterbi(model, r.cost, forced, r.series, r.kind, r.same)
            done = t.append_column("decoded", pa.array(SCALES[states])).filter(pa.array(own)).combine_chunks()
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in done.columns], names=[*names, "decoded"])

    return run


def _passages(model: Model, at: int):
    """The passage through each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_series(batches, at):
            r = _Rows(t, model)
            own = np.asarray(t.column("own").to_numpy(zero_copy_only=False), bool)
            edge = np.flatnonzero(np.concatenate([[True], r.series[1:] != r.series[:-1], [True]]))
            out = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                x = a + np.flatnonzero(own[a:b])
                out.append(passage(model, r.cost[x], r.stated[x], int(r.kind[a]), r.same[x], bool(x[0] == a)).ravel())
            first = pa.array(edge[:-1])
            yield pa.RecordBatch.from_arrays([t.column("whole").combine_chunks().take(first), t.column("block").combine_chunks().take(first), pa.array([list(o) for o in out], pa.list_(pa.float64()))], names=["whole", "block", "paid"])

    return run


def _ends(t: pd.DataFrame) -> pd.DataFrame:
    """The scales at the ends of the blocks of one series, from what the passages cost."""
    t = t.sort_values("block")
    k = len(SCALES)
    paid, back = np.zeros(k), []
    for m in t.paid:
        total = paid[:, None] + np.asarray(m).reshape(k, k)
        back.append(total.argmin(0))
        paid = total.min(0)
        paid -= paid.min()
    at, leave = int(paid.argmin()), []
    for b in reversed(back):
        leave.append(at)
        at = int(b[at])
    leave.reverse()
    return pd.DataFrame({"whole": t.whole.to_numpy(), "block": t.block.to_numpy(), "entry": [-1, *leave[:-1]], "leave": leave})


def _blocks(model: Model, rows: DataFrame, block: int) -> DataFrame:
    """Rows of hot series with those around each block of them, and the scales at the blocks' ends."""
    block = max(block, AROUND + 1)
    rows = running_sums(rows.withColumn("one", F.lit(1)), ["whole"], ["time", "row_id"], {"place": "one"}, upto=False).drop("one")
    mine, off = F.floor(F.col("place") / block), F.col("place") % block
    to = lambda d, own: F.struct((mine + d).alias("block"), F.lit(own).alias("own"))
    copies = F.array_compact(F.array(to(0, True), F.when(off < AROUND, to(-1, False)), F.when(off >= block - AROUND, to(1, False))))
    rows = rows.withColumn("copy", F.explode(copies)).select("*", "copy.block", "copy.own").drop("copy", "place").where("block >= 0")
    rows = rows.withColumn("series", F.xxhash64("whole", "block"))
    some = rows.where("own").select("series").distinct()
    rows = materialise(rows.join(some, "series", "left_semi").select(rows.columns), "blocks")
    laid = rows.repartition("series").sortWithinPartitions("series", "time", "row_id")
    paid = laid.mapInArrow(_passages(model, rows.columns.index("series")), "whole bigint, block bigint, paid array<double>")
    ends = materialise(paid.groupBy("whole").applyInPandas(_ends, "whole bigint, block bigint, entry int, leave int"), "ends")
    return rows.join(ends, ["whole", "block"], "left").select(*rows.columns, "entry", "leave")


def decode_units(facts: DataFrame, id_col: str = "line_id", hot_rows: int = HOT_ROWS, block: int = BLOCK, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every figure with its unit: ``id_col``, value, account, kind, scale, currency, source, decoded.

    facts: company_code, period, statement, basis, account, value, unit, currency, unit_note, loaded_at and ``id_col``.
    kind: money, shares, per_share or ratio.  scale, source: what is recorded (see ``recorded``); null where nothing is.
    decoded: the scale by the model of the figure's series (company, account, basis, kind, currency, years or
    quarters), in order of period, load and id.  A recorded scale is certain to the model.  Where none is recorded, the jump
    of the figure from the smooth level of the recorded amounts around it, the decimals it is printed with and the learnt moves from scale to scale decide.

    The model is fitted on the recorded rows of about ``fit_rows`` rows: whole series, picked by hash, hot ones left out; every row is decoded.
    Null and zero values have no level and take part by their recorded unit only.  Repeated rows are decoded each; null keys form
    series of their own.  A series of more than ``hot_rows`` rows is decoded in blocks: what it costs to pass through each block is
    found first, from that the scales at their ends, which gives the path of the whole series.
    """
    period = F.upper(F.regexp_replace("period", r"\s", ""))
    year = F.coalesce(F.regexp_extract(period, r"FY([0-9]{4})", 1).try_cast("int"), F.lit(0))
    quarter = F.coalesce(F.regexp_extract(period, r"Q([1-4])", 1).try_cast("int"), F.lit(0))
    keys = ["row_id", "company_code", "basis", "of", "quarterly", "time", "value"]
    src = facts.select(F.col(id_col).alias("row_id"), "company_code", "basis", F.col("currency").alias("of"), (quarter > 0).alias("quarterly"), ((year * 10 + quarter) * F.lit(10**10) + F.coalesce(F.unix_timestamp("loaded_at"), F.lit(0))).cast("double").alias("time"), "value", "account", "statement", "unit", "unit_note")
    schema = ", ".join([*[f"{c} {src.schema[c].dataType.simpleString()}" for c in keys], _PARSED])
    # labels without their units are counted first, which needs no reading of texts; a series lies within one of these groups
    label = F.trim(F.regexp_replace(fold_width(F.col("account")), r"\s*\([^()]*\)\s*$", "")).alias("label")
    large = src.groupBy("company_code", "basis", "of", "quarterly", label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)

    def read(rows: DataFrame) -> DataFrame:
        got = rows.mapInArrow(_read(len(keys), [*keys, *[c.split()[0] for c in _PARSED.split(", ")]]), schema)
        size = F.abs(F.col("value").cast("double"))
        exact = F.col("value").cast("decimal(38,6)")
        printed = F.when(exact == F.round(exact, 0), 0).when(exact == F.round(exact, 2), 1).when(exact == F.round(exact, 4), 2).when(exact.isNull(), 0).otherwise(3)
        got = got.withColumn("level", F.when(size > 0, F.log10(size)).otherwise(F.lit(float("nan")))).withColumn("decimals", printed).withColumn("whole", F.xxhash64("company_code", "basis", "of", "quarterly", "account", "kind"))
        return got.select("row_id", "time", "value", "account", "kind", "scale", "currency", "of", "source", "stated", "level", "decimals", "whole")

    rows = read(src)
    hot = None
    if not large.isEmpty():
        hot = materialise(rows.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("whole"), "hot")
    parts = max(1, -(-facts.count() // fit_rows))
    some = rows if parts == 1 else read(src.where(F.pmod(F.xxhash64("company_code", "basis", "of", "quarterly", label), F.lit(parts)) == 0))
    some = some if hot is None else some.join(hot, "whole", "left_anti")
    t = some.select("whole", "time", "row_id", "kind", "account", "value", "level", "decimals", "stated").limit(4 * fit_rows).toArrow().sort_by([("whole", "ascending"), ("time", "ascending"), ("row_id", "ascending")])
    col = lambda c: t.column(c).to_numpy()
    kind = np.array([KINDS.index(x) for x in t.column("kind").to_pylist()], np.int64)
    model = fit(col("whole"), kind, t.column("account").to_pylist(), col("level"), col("level"), col("decimals"), col("stated").astype(np.int64))
    usual = rows if hot is None else rows.join(hot, "whole", "left_anti")
    none = F.lit(None).cast("int")
    usual = usual.withColumn("series", F.col("whole")).withColumns({"own": F.lit(True), "entry": none, "leave": none})
    if hot is not None:
        usual = usual.unionByName(_blocks(model, rows.join(hot, "whole", "left_semi"), block).drop("block"))
    usual = usual.drop("whole").repartition("series").sortWithinPartitions("series", "time", "row_id")
    out = ", ".join(f"{c} {usual.schema[c].dataType.simpleString()}" for c in usual.columns) + ", decoded bigint"
    got = usual.mapInArrow(_decode(model, usual.columns), out)
    return got.select(F.col("row_id").alias(id_col), "value", "account", "kind", "scale", F.coalesce("currency", F.upper("of")).alias("currency"), "source", "decoded")


def common_units(facts: DataFrame, id_col: str = "line_id", **how) -> DataFrame:
    """Every figure in the common unit of its quantity, or the reason why not: ``id_col``, value, common_value, common_unit, scale, source, likely_scale, reason.

    Money comes out in 元 or 美元 (no exchange), counts of shares in 股.  reason: null where converted, else no_value, not_a_quantity (ratios and
    amounts per share), no_unit, unit_of_other_kind, unreadable_unit or too_large.  likely_scale is what the model of the series decodes;
    it is a proposal where no unit is recorded, never a conversion.
    """
    d = decode_units(facts, id_col, **how)
    named = F.col("source").isin("exception", "unit", "note", "label")
    common = F.when(named, F.try_multiply("value", F.col("decoded").cast("decimal(10,0)")).try_cast("decimal(38,6)"))
    reason = (
        F.when(F.col("value").isNull(), "no_value").when(~F.col("kind").isin(MONEY, SHARES), "not_a_quantity").when(F.col("source").isNull(), "no_unit")
        .when(F.col("source") == "other_kind", "unit_of_other_kind").when(F.col("source") == "unreadable", "unreadable_unit").when(common.isNull(), "too_large")
    )
    unit = F.when(F.col("kind") == SHARES, "股").when(F.col("currency") == "USD", "美元").otherwise("元")
    d = d.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return d.select(id_col, "value", F.when(ok, common).alias("common_value"), F.when(ok, unit).alias("common_unit"), F.when(named, F.col("scale")).alias("scale"), "source", F.col("decoded").alias("likely_scale"), "reason")
