"""Token ids against the libraries that own the vocabulary."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldspan.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tokens.Encoder(), public


def ids(enc, texts):
    o, i = enc.encode(texts)
    return [i[a:b].tolist() for a, b in zip(o, o[1:])]


EDGE = [None, "", " ", "\n\n\n", " \n x", "a\n\n b", "<|endoftext|>", "it's we'll I'D", "A" * 3000, "ab" * 700, "\r\n\tx\r\n", "日本語の文章。" * 50, "é́  　 \x1c\x85", "🎉🎊" * 90, "1" * 400, "\x00\x01", "x" * 257, "x" * 256]


def test_edges(both):
    enc, public = both
    assert ids(enc, EDGE) == [public.encode_ordinary(t or "") for t in EDGE]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=6))
def test_any_text(both, texts):
    enc, public = both
    assert ids(enc, texts) == [public.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("aA b\n\r\t1'sdl.,é　")), max_size=400))
def test_dense_alphabet(both, text):
    enc, public = both
    assert ids(enc, [text]) == [public.encode_ordinary(text)]


def test_memo_limits_do_not_change_ids(both, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 3)
    monkeypatch.setattr(tokens, "MEMO_LINE_CHARS", 5)
    enc, public = both
    for t in ("first words here", "other words there\nand more", "first words here"):
        assert ids(enc, [t]) == [public.encode_ordinary(t)]


def test_table(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(EDGE)] + [(0, None, None, None), (3, "\n\n\n", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, tokens int")
    got = tokens.encode(df, chars_a_step=10).collect()
    assert len(got) == len(rows) and got[0].ids == []
    n = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in got)
    assert tokens.encode(df.limit(0)).count() == 0


def test_flat_rows_merge_like_matrices():
    rng, enc = np.random.default_rng(8), tokens.encoder(tokens.TOKENIZERS, "byte_bpe_50k")
    words = [w for w in enc.ranks if 1 < len(w) < 12][:4000]
    pieces = []
    for i in range(300):
        n = int(rng.integers(257, 700))
        kind = i % 4
        raw = bytes(rng.integers(97, 97 + (3, 26, 5, 2)[kind], n, dtype=np.uint8)) if kind != 2 else b"".join(words[int(k)] for k in rng.integers(0, len(words), n // 4 + 80))
        pieces.append(raw[:700])
    for raw, ids in zip(pieces, enc._matrix(pieces, 700)):
        assert list(enc._flat(raw)) == list(ids)
