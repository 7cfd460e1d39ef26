"""Garbled text and outranking."""

import math
import random

import numpy as np
import pytest

from factlode.llm.mojibake import LEAST, repair_encoding, segments
from factlode.llm.outrank import net_flow_ranking

SENTENCES = ["研發團隊完成11項光纖收發器專利申請，累計投入10,624千元。", "公司與往來銀行簽訂額度14,417千元之授信合約，利率為18.48%。", "截至108年6月3日止，應付帳款餘額1,804千元，帳齡逾68日者占39.65%。", "管理階層認為主要客戶調整拉貨時程僅屬短期現象。", "The board approved a budget of NT$39,819 thousand, see note 4."]
FINE = ["子公司 Brévaux Équipements S.A. 與 Ångby Verkstäder AB 已完成清算。", "轉投資之 ООО «Северлад» 與 АО «Тарнов» 於本期停業。", " 關於保留盈餘之會計估計", "①②③各項詳附表，※ 為關係人，■ 為主要產品。", "日本據點カワミネ製作所之代理合約屆滿。", "It covers £40 per unit and a 5 µm coating — naïve.", "┌──┐\n│表│\n└──┘", "東埔廠𠮷區之冷鏈設備®"]


def garbled(text):
    two = lambda read: text.encode("utf_8").decode(read, "replace")
    return {
        "cp1251": text.encode("utf_8").decode("cp1251", "replace"), "latin_1": text.encode("utf_8").decode("latin_1"), "mac_roman": text.encode("utf_8").decode("mac_roman"), "koi8_r": text.encode("utf_8").decode("koi8_r"), "cp437": text.encode("utf_8").decode("cp437"),
        "twice": text.encode("utf_8").decode("latin_1").encode("utf_8").decode("latin_1"), "gbk": two("gbk"), "cp932": two("cp932"), "swapped": text.encode("utf_16_le").decode("utf_16_be", "replace"), "big5 as gbk": text.encode("cp950").decode("gbk", "replace"), "gbk as big5": text.encode("gbk").decode("cp950", "replace"), "broken": text.encode("cp950").decode("utf_8", "replace"),
    }


def test_garbled_parts_are_found_and_restored(spark):
    rng = random.Random(1)
    rows = [(f"s{i}", "".join(rng.choice(SENTENCES) for _ in range(6))) for i in range(400)] + [(f"f{i}", rng.choice(SENTENCES) + "\n" + f + rng.choice(SENTENCES)) for i, f in enumerate(FINE * 3)]
    bad, exact = {}, ["latin_1", "mac_roman", "koi8_r", "cp437", "twice"]
    for k, s in enumerate(SENTENCES[:3]):
        for name, g in garbled(s).items():
            bad[f"{name} {k}"] = (SENTENCES[3] + g + SENTENCES[3], SENTENCES[3] + s + SENTENCES[3])
    bad["short"] = ("depreciation of Â£40 per unit", "depreciation of £40 per unit")
    bad["digits"] = ("存貨淨額為千元", "存貨淨額為14,5千元")
    rows += [(k, t) for k, (t, _) in bad.items()] + [("null", None), ("empty", ""), ("blank", " \n"), (None, "piÃ±a"), ("s0", rows[0][1]), ("one", "�")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "chunk_id string, text string, restored string")
    got = {r.chunk_id: r for r in repair_encoding(df).collect()}
    assert set(got) == {*bad, None, "one"}
    for k, (_, right) in bad.items():
        if k.split(" ")[0] in exact or k in ("short", "digits"):
            assert got[k].restored == right, k
            assert got[k].unrestored_chars == 0
    assert sum(SENTENCES[0][:6] in got[f"{n} 0"].restored for n in ("gbk", "cp932", "swapped")) >= 2
    assert got["one"].unrestored_chars == 1 and got["broken 0"].unrestored_chars > 0
    assert repair_encoding(df.limit(0)).count() == 0


def test_a_damage_copied_into_a_third_of_the_rows_is_found(spark):
    rng = random.Random(3)
    rows = [(f"s{i}", "".join(rng.choice(SENTENCES) for _ in range(6)) + str(i)) for i in range(300)] + [(f"c{i}", "see the cafÃ© at BrÃ©vaux. " + SENTENCES[0]) for i in range(150)] + [(f"f{i}", f + str(i)) for i, f in enumerate(FINE * 3)]
    got = {r.chunk_id: r.restored for r in repair_encoding(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert got == {f"c{i}": "see the café at Brévaux. " + SENTENCES[0] for i in range(150)}


def test_segments():
    s = np.array([-1, 1, 1, -1, 2, -5, 1, -3, 0.1])
    assert segments(s, np.ones(9, bool)) == [(1, 4), (6, 6)]
    assert segments(s, np.zeros(9, bool)) == [] and segments(np.zeros(0), np.zeros(0, bool)) == []


def test_segments_are_the_same_behind_many_texts():
    s = np.tile(np.array([-2, LEAST, -2, -1e6], np.float32), 10_000)
    assert segments(s, s > 0) == [(i, i) for i in range(1, len(s), 4)]


def brute(rows, q=0.05, s=0.5):
    best = {}
    for g, i, r, x, t in rows:
        if None in (g, i, r):
            continue
        ok = x is not None and math.isfinite(x)
        old = best.get((g, i, r))
        key = (ok, t or "", x if ok else 0)
        if old is None or key > old[0]:
            best[g, i, r] = (key, x if ok else None)
    out = {}
    for g in {k[0] for k in best}:
        items = sorted({k[1] for k in best if k[0] == g})
        n, flow, used = len(items), dict.fromkeys(items, 0.0), 0
        for r in sorted({k[2] for k in best if k[0] == g}):
            x = [best.get((g, i, r), (0, None))[1] for i in items]
            if all(v is None for v in x):
                continue
            used += 1
            v = [-math.inf if a is None else a for a in x]
            pct = [(sum(b < a for b in v) * 2 + sum(b == a for b in v) + 1) / (2 * n) for a in v]
            pref = lambda d: min(1.0, max(0.0, (d - q) / (s - q)))
            for a, i in enumerate(items):
                flow[i] += sum(pref(pct[a] - p) - pref(p - pct[a]) for p in pct) / max(n - 1, 1)
        for i in items:
            out[g, i] = round(flow[i] / max(used, 1), 9)
    return out


@pytest.mark.parametrize("hot", [10**6, 5])
def test_net_flow_equals_all_pairs(spark, hot):
    rng = random.Random(7)
    rows = [(f"q{rng.randint(0, 3)}", f"c{rng.randint(0, 30)}", rng.choice("abc"), rng.choice([round(rng.random(), 1), 1e9 * rng.random(), None, float("nan"), float("inf"), 0.5]), rng.choice([None, "2026-01-01 00:00:00", "2026-01-02 00:00:00"])) for _ in range(500)]
    rows += rows[:20] + [("lone", "c", "a", 1.0, None), ("none", "c1", "a", None, None), ("none", "c2", "a", None, None), (None, "c", "a", 1.0, None), ("q0", None, "a", 1.0, None), ("q0", "c", None, 1.0, None)]
    df = spark.createDataFrame([(*r[:4], r[4], 1) for r in rows], "question_id string, chunk_id string, retriever string, score double, run_at string, rank int").selectExpr("question_id", "chunk_id", "retriever", "score", "cast(run_at as timestamp) run_at", "rank")
    got = net_flow_ranking(df, hot_rows=hot).collect()
    want = brute([(*r[:4], r[4]) for r in rows])
    assert {(r.question_id, r.chunk_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.net_flow - want[r.question_id, r.chunk_id]) < 2e-9 for r in got)
    for g in {r.question_id for r in got}:
        order = [(r.chunk_id, r.net_flow) for r in sorted((r for r in got if r.question_id == g), key=lambda r: r.rank)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        assert sorted(r.rank for r in got if r.question_id == g) == list(range(1, len(order) + 1))
    assert net_flow_ranking(df.limit(0)).count() == 0
