from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomill.llm import splitting as S
from chronomill.llm.words import encoder, token_bytes

encode, table = encoder().encode_ordinary, token_bytes()


def check(text, limit, overlap):
    pieces = S.split(text, encode, table, limit, overlap)
    assert bool(pieces) == (len(encode(text)) > limit)
    if pieces:
        assert pieces[0].start == 0 and pieces[-1].end == len(text) and pieces[-1].kind == "end"
        for p in pieces:
            assert len(encode(text[p.start : p.end])) == p.n_tokens <= limit
        for a, b in zip(pieces, pieces[1:], strict=False):
            assert a.start < b.start <= a.end < b.end
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "end. ", "\n", "\n\n", "的", "。", "x" * 30, "😀", "1,2,", "\r\n", "é"]), max_size=200), st.integers(20, 60))
def test_pieces_cover_and_fit(parts, limit):
    check("".join(parts), limit, limit // 6)


def test_natural_boundaries_and_overlap():
    text = "\n\n".join(" ".join(f"Sentence number {k} has some words." for k in range(j, j + 9)) for j in range(0, 900, 9))
    pieces = check(text, 500, 50)
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.kind == "paragraph" and text[a.end - 2 : a.end] == "\n\n" and 40 <= b.n_overlap <= 110
    lines = check("\n".join("short line of code here" for _ in range(600)), 500, 50)
    assert {p.kind for p in lines[:-1]} == {"line"}
    assert {p.kind for p in check("word " * 3000, 500, 50)[:-1]} == {"word"}


@pytest.mark.parametrize("text", ["a" * 9000, "的" * 5000, " " * 20000, "\n" * 9000, "😀" * 3000, "deadbeef01" * 2000, "٣" * 4000])
def test_texts_without_boundaries(text):
    check(text, 300, 30)


def test_every_natural_boundary_comes_before_a_cut_between_characters():
    # Word ends, then a run without any: the last word end is the cut, however near it is.
    text = "word " * 140 + "deadbeef01" * 900
    pieces = check(text, 500, 50)
    assert pieces[0].kind == "word" and text[: pieces[0].end].rstrip().endswith("word") and pieces[0].end >= 139 * 5
    assert {p.kind for p in pieces[1:-1]} == {"character"}
    # A paragraph in the first half loses to the farthest boundary of the last half.
    text = "A few words. " * 40 + "\n\n" + "More words here. " * 400
    first = check(text, 500, 50)[0]
    assert first.kind == "sentence" and first.n_tokens > 480


def test_greedy_cuts_by_doubling_are_those_of_a_walk():
    rng = random.Random(4)
    for n in (1, 2, 17, 400):
        nxt = np.array([min(n - 1, k + rng.randint(1, 5)) for k in range(n)])
        walk, at = [0], 0
        while nxt[at] != at:
            at = int(nxt[at])
            walk.append(at)
        assert S.greedy(np.arange(n), nxt).tolist() == walk


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "many words here. " * 900, "x"), (4, "many words here. " * 900, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    out = S.split_documents(df).orderBy("piece_no").collect()
    assert {r.doc_id for r in out} == {4} and all(r.n_tokens <= 2000 for r in out)
    assert S.split_documents(df.limit(0)).count() == 0
