"""Shared spans against brute force."""

import random

import numpy as np

from factlode.llm.bpe import codes
from factlode.llm.spans import FingerprintIndex, span_pairs, span_shares
from factlode.llm.winnow import choose, gram_hashes


def brute(rows, span):
    """Pairs of ids and shared characters by id."""
    docs = [(i, t) for i, t in rows if i is not None and t and len(t) >= span]
    windows = {}
    for i, t in docs:
        for k in range(len(t) - span + 1):
            windows.setdefault(t[k : k + span], set()).add(i)
    pairs = {(a, b) for s in windows.values() for a in s for b in s if a < b}
    shared = {}
    for i, t in docs:
        covered = set()
        for k in range(len(t) - span + 1):
            if len(windows[t[k : k + span]]) > 1:
                covered |= set(range(k, k + span))
        shared[i] = len(covered)
    return pairs, shared


def corpus():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("研發團隊完成專利申請累計投入abc \n") for _ in range(n))
    passage, head = text(45), text(39)
    rows = [(1, text(100) + passage + text(50)), (2, passage + text(90)), (3, text(70) + head), (4, head + text(80)), (5, text(120)), (6, None), (7, ""), (8, "短"), (None, passage)]
    rows += [(9, "─" * 60 + text(30)), (10, text(20) + "─" * 75), (11, "─" * 39 + text(50)), (12, ". " * 40 + text(20)), (13, text(5) + " ." * 50), (14, rows[0][1]), (15, rows[0][1]), (5, rows[4][1])]
    rows += [(16, text(33) + "xy" * 10 + passage[:30]), (17, "─" * 41), (18, "　" * 90)]
    return rows


def test_pairs_and_shares_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, cid long")
    pairs, shared = brute(rows, 40)
    got = {(r.doc_id_1, r.doc_id_2) for r in span_pairs(df, gram=16, span=40).collect()}
    assert got == pairs
    out = span_shares(df, gram=16, span=40).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.shared_chars for r in out if r.doc_id is not None} == {i: shared.get(i, 0) for i, _ in rows if i is not None}


def test_one_batch_at_a_time_equals_all_at_once(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and t and len(t) >= 40]
    from factlode.llm.spans import _texts

    texts = _texts(spark.createDataFrame(rows, "id long, t string"), "id", "t", 40).cache()
    whole = FingerprintIndex(spark, 16, 40)
    whole.add(texts)
    steps = FingerprintIndex(spark, 16, 40, fanout=2)
    for k in range(3):
        steps.add(texts.where(f"id % 3 = {k}"))
    assert max(n for n, _ in steps.runs) >= 1  # runs were merged
    pair = lambda x: {(bytes(r.cid_1), bytes(r.cid_2)) for r in x.links(texts).collect()}
    assert pair(whole) == pair(steps) != set()


def test_a_stored_index_takes_another_batch_without_moving_its_history(spark, tmp_path):
    from factlode.llm.spans import _texts, fingerprints

    rows = [(i, t) for i, t in corpus() if i is not None and t and len(t) >= 40]
    texts = _texts(spark.createDataFrame(rows, "id long, t string"), "id", "t", 40).cache()
    first = FingerprintIndex(spark, 16, 40, path=f"file://{tmp_path}/index", buckets=3)
    first.add(texts.where("id % 2 = 0"))
    first.add(texts.where("id % 2 = 1 and id < 9"))
    for t in [r.name for r in spark.catalog.listTables() if r.name.startswith("run_")]:
        spark.sql(f"drop table {t}")  # as in a new session; the files stay
    again = FingerprintIndex(spark, path=f"file://{tmp_path}/index")
    assert (again.gram, again.span, again.buckets, len(again.runs)) == (16, 40, 3, 2)
    new = again._read(again._write(fingerprints(texts.where("id % 2 = 1 and id >= 9"), 16, 40, 3)))
    plan = again.met(new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    again.add(texts.where("id % 2 = 1 and id >= 9"))
    whole = FingerprintIndex(spark, 16, 40)
    whole.add(texts)
    late = {bytes(r.cid) for r in texts.where("id % 2 = 1 and id >= 9").collect()}
    pairs = lambda x: {(bytes(r.cid_1), bytes(r.cid_2)) for r in x.links(texts).collect()}
    want = {p for p in pairs(whole) if late & set(p)}
    assert want and pairs(again) == want  # what the new batch shares with the history and within itself


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert span_pairs(df).count() == 0 and span_shares(df).count() == 0


def test_every_span_holds_a_gram_chosen_in_both():
    rng = random.Random(1)
    for _ in range(200):
        common = "".join(rng.choice("ab") for _ in range(40)) if rng.random() < 0.5 else "".join(chr(rng.randint(97, 122)) for _ in range(40))
        a, b = ("".join(chr(rng.randint(65, 90)) for _ in range(rng.randint(0, 30))) for _ in range(2))
        x, y = a + common + b, b + common + a
        t = x + y
        o, p, h = choose(codes(t), np.array([len(x), len(y)]), 12, 40)
        left = {(int(k), int(q) - len(a)) for k, q, w in zip(h, p, o) if w == 0}
        right = {(int(k), int(q) - len(b)) for k, q, w in zip(h, p, o) if w == 1}
        assert left & right


def test_equal_grams_hash_equally():
    h = gram_hashes(codes("abcdefabcdef"), 6)
    assert h[0] == h[6] and len(set(h.tolist())) == 6
    assert len(gram_hashes(codes("abc"), 6)) == 0
