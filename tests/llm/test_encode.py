"""Encoding: exact against the plain tokenizer, in batches and through the tree."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from factlode.llm.bpe import bpe, codes, piece_starts
from factlode.llm.encode import RANK_FILE, count_tokens, decode_corpus, encode_corpus

ALPHABET = "  \n\n\t'''sstremdlvl,.。中文研發a1２ 3é　\xa0\U0001f600%"


def plain(t):
    return bpe(RANK_FILE).plain.encode_ordinary(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET) | st.characters(blacklist_categories=["Cs"]), max_size=30), min_size=1, max_size=6))
def test_batches_equal_the_plain_encoding(texts):
    ids, n = bpe(RANK_FILE).encode("".join(texts), np.array([len(t) for t in texts]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain(t) for t in texts]
    assert bpe(RANK_FILE).count("".join(texts), np.array([len(t) for t in texts])).tolist() == [len(plain(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_joined_parts_equal_the_whole(text, cuts):
    cuts = sorted({min(c, len(text)) for c in cuts})
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    joined = bpe(RANK_FILE).tree([bpe(RANK_FILE).encoded(p) for p in parts])
    assert joined.ids.tolist() == plain(text) and joined.text == text


def test_long_unsplit_texts_join_inside_a_piece():
    rng = random.Random(3)
    for chars in ("ab", "研發團隊完成", "thequickbrown", "é中a", "0123"):
        t = "".join(rng.choice(chars) for _ in range(3000))
        parts = [t[i : i + 257] for i in range(0, len(t), 257)]
        assert bpe(RANK_FILE).tree([bpe(RANK_FILE).encoded(p) for p in parts]).ids.tolist() == plain(t)


def test_corpus(spark):
    long = "研發團隊" * 3000 + " don't stop " * 900
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", None), (4, long, None), (5, "<|endoftext|>", None), (None, "中", None), (1, "abc", "x"), (6, "  \n ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(i, plain(t or "")) for i, t, _ in rows], key=str)
    assert encode_corpus(df.limit(0)).count() == 0
    assert sorted(r.n for r in count_tokens(df, "text", "n").collect()) == sorted(len(plain(t or "")) for _, t, _ in rows)


def test_piece_starts_of_nothing():
    assert piece_starts(codes(""), np.zeros(0, np.int64)).tolist() == []


def test_strange_characters_and_shared_hashes_touch_their_own_text_only(monkeypatch):
    from factlode.llm import bpe as B
    from factlode.llm.encode import RANK_FILE

    own = B.Bpe(RANK_FILE)
    texts = ["profit rose", "", "a\U0002fffe b", "毛利率 12%", "\U000e0fff\U000e0fff", "profit fell"]
    sizes = np.array([len(t) for t in texts])
    want = [own.plain.encode_ordinary(t) for t in texts]
    for noise in (None, np.zeros(0x110000, np.uint64)):  # without noise, pieces of one length share a hash
        if noise is not None:
            monkeypatch.setattr(B, "_noise", lambda: noise)
            own._forget()
        ids, n = own.encode("".join(texts), sizes)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
        assert own.count("".join(texts), sizes).tolist() == [len(w) for w in want]


def test_ids_decode_to_their_text(spark):
    texts = ["", None, "毛利率 12%", "\x00  a<|endoftext|>b", "𠮷é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decode_corpus(encode_corpus(df)).collect()}
    assert got == {**{i: t or "" for i, t in enumerate(texts)}, None: "x"}
