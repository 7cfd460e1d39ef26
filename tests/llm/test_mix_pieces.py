"""Mixing and splitting."""

import pytest
from hypothesis import given, settings, strategies as st

from factlode.llm.bpe import bpe
from factlode.llm.encode import RANK_FILE
from factlode.llm.mix import mix_sources
from factlode.llm.pieces import cuts, split_oversized, split_text


def docs(spark):
    rows = [(i, "word " * (1 + i % 7), ["big", "Big ", "BIG"][i % 3]) for i in range(600)]
    rows += [(1000 + i, "研發團隊 " * 3, "small") for i in range(20)] + [(2000, None, "small"), (2001, "", "small"), (2002, "zz", None), (2003, "zz", " "), (2004, "zz", "unlisted"), (None, "zz", "big")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def targets(spark):
    return spark.createDataFrame([("big", 0.45, 1), ("small", 0.45, 2), ("absent", 0.1, 4), (None, 0.5, 1), ("negative", -1.0, 2)], "source string, weight double, max_repeats int")


def test_shares_and_caps(spark):
    drawn, shares = mix_sources(docs(spark), targets(spark))
    s = {r.source: r for r in shares.collect()}
    total = sum(r.tokens for r in s.values()) + sum(len(bpe(RANK_FILE).plain.encode_ordinary("zz")) for _ in range(2))
    assert s["small"].capped and s["small"].copies == 2 * s["small"].docs and s["small"].used_tokens == 2 * s["small"].tokens
    assert s["absent"].copies == 0 and s["unlisted"].copies == 0 and s["negative"].copies == 0
    assert abs(s["big"].target_tokens - min(s["big"].tokens, total - 2 * s["small"].tokens)) < 1e-6
    assert abs(s["big"].used_tokens - s["big"].target_tokens) <= 8
    rows = drawn.collect()
    assert len({(r.doc_id, r.source, r.copy) for r in rows}) == len(rows)
    assert max(r.copy for r in rows if r.source == "big") == 1 and max(r.copy for r in rows if r.source == "small") == 2
    assert abs(sum(r.share for r in s.values()) - 1) < 1e-9
    again, _ = mix_sources(docs(spark), targets(spark))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_nothing_to_mix(spark):
    drawn, shares = mix_sources(docs(spark).limit(0), targets(spark))
    assert drawn.count() == 0 and all(r.share == 0 for r in shares.collect())
    drawn, _ = mix_sources(docs(spark), targets(spark).limit(0))
    assert drawn.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("研發a。，\n \r;"), max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    parts = split_text(text, limit, overlap)
    inner = text.strip(" \n\r")
    if not inner:
        assert parts == []
        return
    assert all(len(p["text"]) <= limit for p in parts)
    whole = parts[0]["text"] + "".join(p["text"][overlap:] for p in parts[1:])
    assert whole == inner
    for a, b in zip(parts, parts[1:]):
        assert b["text"][:overlap] == a["text"][len(a["text"]) - overlap :] and text[b["start"] :].startswith(b["text"])


def test_cuts_take_the_strongest_pause_near_the_target():
    text = "字" * 50 + "，" + "字" * 9 + "。" + "字" * 60
    assert cuts(text, 100, 10)[0] == (61, 3)
    assert cuts("字" * 100, 100, 10) == [(100, 5)]
    assert [e for e, _ in cuts("字" * 190, 100, 10)] == [100, 190]


def test_rows_keep_their_columns(spark):
    rows = [("a", "字" * 1300, [1], ["s"], 9), ("b", "短", [2], None, 9), ("c", None, None, None, 9), ("d", " " * 1300, [1], [], 9), ("e", "　" * 90 + "字" * 1200, [1], [], 9), ("a", "字" * 1300, [1], ["s"], 9)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, pages array<int>, section_path array<string>, piece int")
    out = split_oversized(df).collect()
    assert sorted((r.chunk_id, r.piece, r.pieces, r.pages, r.section_path) for r in out) == [("a", 1, 2, [1], ["s"])] * 2 + [("a", 2, 2, [1], ["s"])] * 2
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, overlap=1200)
