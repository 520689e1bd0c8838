"""Splitting oversized texts at natural boundaries, with overlap, by pointer doubling.

Every place where a piece may end is joined to its farthest legal successor: the next piece begins about
``overlap`` tokens before that place and ends at most ``limit`` tokens on, at the end of a paragraph, else of a
line, a sentence, a word or behind a mark. The successor table is squared again and again while the set
of places reached from the start doubles with it; so all greedy cuts of a text come out together, after
logarithmically many steps.

In the last half of what the limit allows the best kind of boundary is taken, and of that kind the farthest. Where
that half has none, the farthest natural boundary is, however short the piece. Only where there is none between the
last cut and the limit is the cut made between two characters. A piece is the text between two places; its tokens
are counted on the piece itself.

Defined cases: null, empty and short texts give no piece; every text is split whole; the pieces cover the
text from its first to its last character; equal texts are split equally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.llm.words import TOKENIZER_DIR, VOCABULARY, encoder, token_bytes

LIMIT, OVERLAP = 2000, 100
KINDS = ("paragraph", "line", "sentence", "word", "mark", "character")
# Bytes of white space, of sentence ends, and the wide marks that end sentences or clauses.
_SPACES, _STOPS, _MARKS = (np.frombuffer(b, np.uint8) for b in (b" \t\n\r\x0b\x0c", b".!?;:", b",;|)]}>"))
_WIDE_STOPS, _WIDE_MARKS = "。！？；", "，、："


class Piece(NamedTuple):
    start: int
    end: int
    n_tokens: int
    n_overlap: int
    kind: str


def _after_wide(a: np.ndarray, marks: str) -> np.ndarray:
    """Places right after any of some three-byte marks."""
    out = np.zeros(len(a) + 1, bool)
    if len(a) > 2:
        v = a[:-2].astype(np.int64) << 16 | a[1:-1].astype(np.int64) << 8 | a[2:]
        out[3:] = np.isin(v, [int.from_bytes(m.encode(), "big") for m in marks])
    return out


def boundaries(data: bytes) -> list[np.ndarray]:
    """Byte places (0 and the length excluded) of each kind of boundary; each kind includes the better ones."""
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    space = np.isin(a, _SPACES)
    before = lambda m: np.append(False, m)
    after = lambda m: np.append(m, False)
    lf, cr = a == 10, a == 13
    cr &= ~after(lf)[1 : n + 1] if n else cr
    end = lf | cr
    line = before(end) & ~after(end)
    # A blank line: the line break before this one is parted from it by white space only.
    idx = np.arange(n)
    last_end = np.maximum.accumulate(np.where(end, idx, -1))
    last_word = np.maximum.accumulate(np.where(~space, idx, -1))
    blank = end & (np.append(-1, last_end[:-1]) > np.append(-1, last_word[:-1]))[:n]
    paragraph = before(blank) & line
    sentence = before(np.isin(a, _STOPS)) & after(space) | _after_wide(a, _WIDE_STOPS)
    word = before(~space) & after(space) | before(space) & after(~space) | _after_wide(a, _WIDE_MARKS)
    kinds = [paragraph]
    for m in (line, sentence, word, before(np.isin(a, _MARKS))):
        kinds.append(kinds[-1] | m)
    for m in kinds:
        m[0] = m[n] = False
    return [np.flatnonzero(m) for m in kinds]


def greedy(starts: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Indices reached from index 0 when each leads to its successor (its own index: the end of the chain)."""
    reached, jump = np.array([0]), successor
    while True:
        more = np.union1d(reached, jump[reached])
        if len(more) == len(reached):
            return reached
        reached, jump = more, jump[jump]


def _plan(ends: np.ndarray, kinds: list[np.ndarray], chars: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes of each piece. ``ends``: byte place after each token; ``chars``: places between characters."""
    n, size = len(ends), int(ends[-1])
    # Tokens up to a place, the one it may fall into included; and those that lie wholly before it.
    upto = lambda places: np.searchsorted(ends, places) + 1
    before = lambda places: np.searchsorted(ends, places, side="right")
    fine = chars[np.isin(chars, ends)]
    fine = fine if len(fine) else chars
    # Every place where a piece may end, and where the piece after that end begins: about ``overlap`` tokens back.
    end = np.unique(np.concatenate([[0], kinds[-1], fine]))
    want = (before(end) - overlap).clip(0)

    def back(places: np.ndarray) -> np.ndarray:
        return places[(np.searchsorted(before(places), want, side="right") - 1).clip(0)]

    begin = back(np.append(0, kinds[-1]))
    begin = np.where(before(begin) < want - overlap, np.maximum(begin, back(np.append(0, fine))), begin)
    begun = before(begin)

    stop = np.where(n - begun <= limit, size, -1)

    def reach(places: np.ndarray, least: int) -> None:
        """End pieces that still have none at the farthest of some places that the limit allows and that moves on."""
        if len(places):
            at = upto(places)
            i = np.searchsorted(at, begun + limit, side="right") - 1
            i, some = i.clip(0), i >= 0
            good = (stop < 0) & some & (at[i] >= begun + least) & (places[i] > end)
            stop[good] = places[i[good]]

    for places in kinds:
        reach(places, limit // 2)
    reach(kinds[-1], 1)
    reach(fine, 1)
    stuck = stop < 0
    if stuck.any():  # one token longer than the limit allows: on by a character place
        stop[stuck] = np.append(fine, size)[np.searchsorted(fine, end[stuck], side="right")]
    following = np.where(stop >= size, np.arange(len(end)), np.searchsorted(end, stop).clip(max=len(end) - 1))
    chain = greedy(end, following)

    def kind(place: int) -> str:
        if place >= size:
            return "end"
        at = [np.searchsorted(k, place) for k in kinds]
        return next((name for name, k, i in zip(KINDS, kinds, at, strict=False) if i < len(k) and k[i] == place), KINDS[-1])

    return [(int(begin[i]), int(stop[i]), kind(int(stop[i]))) for i in chain]


def split(text: str | None, encode: Callable[[str], list[int]], table: list[bytes], limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """The pieces of a text of more than ``limit`` tokens, in characters; none for a shorter one."""
    data = (text or "").encode()
    if len(data) <= limit:  # a token has at least one byte
        return []
    ids = encode(text)
    if len(ids) <= limit:
        return []
    a = np.frombuffer(data, np.uint8)
    lead = (a & 0xC0) != 0x80
    chars = np.flatnonzero(lead)[1:]
    ends = np.cumsum(np.fromiter((len(table[i]) for i in ids), np.int64, len(ids)))
    kinds = boundaries(data)
    kinds = [k[lead[k]] for k in kinds]
    char_no = np.concatenate([[0], np.cumsum(lead)])
    room = limit
    while True:
        plan = _plan(ends, kinds, chars, room, overlap)
        counts = [len(encode(data[s:e].decode())) for s, e, _ in plan]
        if max(counts) <= limit:
            break
        room -= max(1, max(counts) - limit)
    out, before = [], 0
    for (s, e, kind), n in zip(plan, counts, strict=True):
        shared = len(encode(data[s:before].decode())) if before > s else 0
        out.append(Piece(int(char_no[s]), int(char_no[e]), n, shared, kind))
        before = e
    return out


def split_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP,
    directory: str = TOKENIZER_DIR, name: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, n_tokens, n_overlap, cut_at, piece) of every oversized document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, start_char int, end_char int, n_tokens int, n_overlap int, cut_at string, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(directory, name).encode_ordinary, token_bytes(directory, name)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, p in enumerate(split(t, encode, table, limit, overlap)):
                    at.append(i)
                    rows.append((k, *p, t[p.start : p.end]))
            types = [pa.int32()] * 5 + [pa.string()] * 2
            cols = list(zip(*rows, strict=True)) or [()] * 7
            ids = b.column(0).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[f.split()[0] for f in schema.split(", ")])

    # A text of at most ``limit`` bytes cannot have more tokens, and is not sent to Python.
    return docs.where(F.octet_length(text) > limit).select(doc_id, text).mapInArrow(run, schema)
