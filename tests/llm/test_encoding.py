from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomill.llm import encoding as E
from chronomill.llm.words import encoder, is_joint, token_bytes

encode, table = encoder().encode_ordinary, token_bytes()

ALPHABET = "aB é'\n\t 　1٣.,-_!?'sstre的。，́😀\r\x1c\xa0"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=40), st.text(ALPHABET, max_size=40))
def test_certain_places_are_certain(a, b):
    if a and b and is_joint(a[-1], b[0]):
        assert encode(a) + encode(b) == encode(a + b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, min_size=1, max_size=12), min_size=1, max_size=8))
def test_any_cut_is_repaired(parts):
    own = [(k > 0 and is_joint(parts[k - 1][-1], p[0]), encode(p)) for k, p in enumerate(parts)]
    own[0] = (True, own[0][1])
    assert E.joined(own, encode, table) == encode("".join(parts))


def test_chunks_are_content_defined():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "x1", "the", "of", "\n", "是的。"]
    shared = " ".join(rng.choice(words) for _ in range(4000))
    a, b = E.chunks(["start " + shared, "another, longer beginning! " + shared])
    assert "".join(a).endswith(shared) and len(set(a) & set(b)) > 0.8 * len(a)
    assert all(len(c) <= E.MOST + E.LOOK_ON for c in a)


LONG = ["a" * 50_000, "的" * 20_000, " " * 30_000, "-" * 20_000, "ab1" * 9000, "x\n" * 9000, "😀" * 6000, "é" * 9000, "it's " * 5000]


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|> as text", *LONG] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 3000))) for _ in range(40)] + ["common passage, shared by many. " * 60] * 20
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "x", b"k") for k, t in rows + rows[:9]], "doc_id bigint, text string, pos string, key binary").repartition(5)
    got = [(r.doc_id, list(r.ids)) for r in E.encode_corpus(df).collect()]
    assert sorted(k for k, _ in got) == [k for k, _ in rows]
    assert all(ids == (encode(texts[k]) if texts[k] else []) for k, ids in got)


def test_frequent_chunks_are_dealt_out_and_keys_of_any_kind_work(spark):
    texts = ["common passage, shared by many. " * 90] * 60 + ["", None] * 20 + [f"own {k} " * k for k in range(50)]
    rows = [(None if k == 3 else f"d{k}", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "name string, body string").repartition(4)
    for often in (2, 7):
        got = {r.doc_id: list(r.ids) for r in E.encode_corpus(df, "name", "body", often=often).collect()}
        assert got == {k: encode(t) if t else [] for k, t in rows}


def test_empty_table(spark):
    assert E.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("text", LONG)
def test_cuts_cover_the_text(text):
    (parts,) = E.chunks([text])
    assert "".join(parts) == text
