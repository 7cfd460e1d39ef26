"""Grouped splits and cross-split overlaps."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factlode.llm.groups import allocate, balance, components, grouped, grouped_splits
from factlode.llm.overlap import chunk_overlaps, chunks, normal_question, overlaps_within, question_overlaps, same_question, slip_keys, slips, thin


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    nodes = [f"n{i:03d}" for i in range(150)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(110)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("x", None), (None, "y"), ("z", "z")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a and b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}


def test_balance_is_even_and_loses_nothing():
    rng = random.Random(4)
    w = {f"i{k}": rng.randint(1, 50) for k in range(400)}
    bins = balance(w, 20)
    assert len(bins) == 20 and sorted(n for _, ns in bins for n in ns) == sorted(w)
    assert all(sum(w[n] for n in ns) == x for x, ns in bins)
    assert max(x for x, _ in bins) - min(x for x, _ in bins) <= 2
    assert balance({}, 5) == [] and balance({"a": 3}, 5) == [(3, ["a"])]
    assert set(allocate(bins, {"train": 0.8, "test": 0.2, "none": 0.0}).values()) == {"train", "test"}


def gold_like(spark):
    rows = [(f"q{i}", [f"c{i % 40}", f"c{(i % 40) + 1}" if i % 97 == 0 else None]) for i in range(900)] + [("lone", []), ("null", None), (None, ["c1"]), ("q1", ["c1", None])]
    return spark.createDataFrame(rows, "question_id string, ks array<string>")


def test_splits_keep_groups_whole(spark):
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2), (None, 0.5), ("off", 0.0)], "split_name string, share double")
    out = grouped_splits(gold_like(spark), targets, "question_id", F.col("ks"), bins=20).collect()
    assert len(out) == len({r.question_id for r in out}) == 902
    per = {}
    for r in out:
        if r.group_key:
            per.setdefault(r.group_key, set()).add(r.split_name)
    assert all(len(s) == 1 for s in per.values())
    assert abs(sum(r.split_name == "train" for r in out) / 902 - 0.8) < 0.05
    assert all(r.split_name is None for r in grouped_splits(gold_like(spark), targets.limit(0), "question_id", F.col("ks")).collect())
    assert grouped_splits(gold_like(spark).limit(0), targets, "question_id", F.col("ks")).count() == 0


def test_group_sizes(spark):
    g = {r.id: (r.group_key, r.group_size) for r in grouped(gold_like(spark), "question_id", F.col("ks")).collect()}
    assert g["lone"] == (None, 0) and g["null"] == (None, 0) and g["q0"][0] == "c0" and g["q0"][1] >= 2


def test_questions_are_normal():
    a = normal_question("請問民國１１０年度曜禾航運「霖謙石專案」之營業成本是多少？")
    b = normal_question("曜禾航運 “霖謙石專案”2021年度的營業成本為何（請附單位）")
    assert a == b and a[1] == ("2021",)
    assert normal_question("根財務報告，FY2021Q4 X公司")[1] == ("2021Q4",) and normal_question(None) == ("", ())
    assert normal_question("民國112年第二季")[1] == ("2023Q2",)


def test_slips():
    assert slips("營業成本走勢圖", "營業成本走勢勢圖") and slips("營業成本走勢圖", "營業成本勢圖") and slips("", "")
    assert not slips("應收帳款", "應付帳款") and not slips("營業毛利占", "營業利益占") and not slips("營業成本", "營業毛利")
    assert slips("甲乙丙丁戊己庚辛", "甲丙丁戊己庚辛".replace("辛", "") + "辛") and not slips("本期淨利", "基本每股盈餘")


def test_chunks_cover_the_text():
    t = "曜禾航運霖謙石專案設備汰換" * 3
    assert sum(n for _, n in chunks(t)) <= len(t) and chunks("") == [] and chunks("a") == chunks("a")


GOLD = "question_id string, question_set string, question string, company struct<name:string,code:string>, period string, source_document array<string>, page_numbers array<int>"


@pytest.mark.parametrize("hot", [2000, 1])
def test_overlaps_of_questions(spark, hot):
    doc = ["0424-FY2021-XB"]
    q = "曜禾航運在民國110年度說明「霖謙石專案」設備汰換之主要原因為何？"
    rows = [
        ("D1", "dev", q, ("x", "0424"), "FY2021", doc, [97]), ("L1", "locked", q.replace("民國110", "西元2021").replace("「", '"').replace("」", '"'), ("x", "TW0424"), None, ["0424_fy2021_xb.pdf"], [97, 98]),
        ("L2", "locked", q.replace("設備汰換", "產能調整"), ("x", "0424"), "FY2021", doc, [97]), ("L3", "locked", q, ("x", "0424"), "FY2021", doc, [5]), ("L4", "probe", q, ("x", "0424"), "FY2021", ["0424-FY2022-XB"], [97]),
        ("L5", "probe", q.replace("110", "111"), ("x", "0424"), "FY2022", doc, [97]), ("L6", "probe", None, None, None, None, None), ("L7", "probe", "", ("x", None), "FY2021", doc, [97]), (None, "probe", q, ("x", "0424"), "FY2021", doc, [97]),
        ("D2", "challenger", q, ("x", "0424"), "FY2021", doc, [97]), ("D1", "dev", q, ("x", "0424"), "FY2021", doc, [97]), ("L8", None, q, ("x", "0424"), "FY2021", doc, [97]), ("L9", "locked", q, None, "FY2021", [None, *doc], [None, 97]),
    ]
    df = spark.createDataFrame(rows, GOLD)
    got = {(r.question_id_1, r.question_id_2) for r in question_overlaps(df, hot_block=hot).collect()}
    assert got == {("D1", "L1"), ("D2", "L1"), ("D1", "L9"), ("D2", "L9")}
    assert question_overlaps(df.limit(0)).count() == 0


def test_rare_chunks_lose_no_pair(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(4)) for _ in range(60)]
    texts = ["共同前言" * 3 + "".join(rng.choice(words) for _ in range(5)) for _ in range(160)]
    rows = [(f"r{i}", i % 2 == 0, t, ["b"] if i % 7 else ["b", "c"]) for i, t in enumerate(texts)] + [("none", True, None, ["b"]), ("blank", False, "", ["b"]), ("off", True, texts[1], [])]
    df = spark.createDataFrame(rows, "rec string, side boolean, text string, blocks array<string>")
    cut = {r[0]: dict(chunks(r[2] or "")) for r in rows}
    want = set()
    for a in rows:
        for b in rows:
            if not a[1] and b[1] and a[2] and b[2] and set(a[3]) & set(b[3]):
                both = sum(n for d, n in cut[a[0]].items() if d in cut[b[0]])
                if both / min(sum(cut[a[0]].values()), sum(cut[b[0]].values())) >= 0.6 and both / max(sum(cut[a[0]].values()), sum(cut[b[0]].values())) >= 0.6:
                    want.add((a[0], b[0]))
    got = {(r.rec_1, r.rec_2) for r in chunk_overlaps(df, 0.6).collect()}
    assert want <= got and want


def test_slip_keys_meet_whatever_slips_accepts():
    texts = ["".join(t) for n in range(1, 8) for t in itertools.product("甲乙", repeat=n)] + ["甲乙丙丁戊己庚辛"[:i] + "甲乙丙丁戊己庚辛"[i + 1 :] for i in range(8)]
    keys = [set(slip_keys(t)) for t in texts]
    assert all(k & m for (a, k), (b, m) in itertools.product(zip(texts, keys), repeat=2) if slips(a, b))


@pytest.mark.parametrize("hot", [2000, 20])
def test_a_slip_at_any_place_loses_no_pair(spark, hot):
    rng = random.Random(5)
    doc, rows = ["0424-FY2021-XB"], []
    for k in range(12):
        q = "".join(rng.sample("曜禾航運霖謙石專案設備汰換營業成本毛利資產總額", 10 + k % 5))
        rows.append((f"D{k}", "dev", q, ("x", "0424"), "FY2021", doc, [k]))
        rows += [(f"L{k}-{i}", "locked", q[:i] + q[i + 1 :], ("x", "0424"), "FY2021", doc, [k]) for i in range(len(q))]
        rows += [(f"M{k}-{i}", "probe", q[:i] + q[i] + q[i:], ("x", "0424"), "FY2021", doc, [k]) for i in range(len(q))]
    normal = {r[0]: normal_question(r[2]) for r in rows}
    one = lambda a, b: same_question(*normal[a[0]], a[4], a[3][1], *normal[b[0]], b[4], b[3][1])
    want = {(a[0], b[0]) for a in rows if a[1] == "dev" for b in rows if b[1] != "dev" and a[6] == b[6] and one(a, b)}
    got = {(r.question_id_1, r.question_id_2): r.overlap for r in question_overlaps(spark.createDataFrame(rows, GOLD), hot_block=hot).collect()}
    assert set(got) == want and min(got.values()) < 0.35


def test_chunks_and_thin_records_meet_whatever_slips_accepts():
    rng = random.Random(6)
    base = ["".join(rng.choice("曜禾航運霖謙石專案設備汰換") for _ in range(n)) for n in (1, 2, 3, 6, 12, 18, 30, 60) for _ in range(6)]

    def typed(t):
        i = rng.randrange(len(t))
        t = t[:i] + t[i + 1 :] if rng.random() < 0.6 else t
        return "".join(c * rng.choice([1, 1, 1, 1, 2]) for c in t)

    left, right = [typed(t) for t in base for _ in range(4)], [typed(t) for t in base for _ in range(4)]
    left, right = [t for t in left if t], [t for t in right if t]
    found = overlaps_within(left, right)
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if slips(a, b)}
    assert want <= set(found) and any(not thin(chunks(left[i])) for i, _ in want) and any(thin(chunks(left[i])) for i, _ in want)
