"""Encoding of a whole corpus with a public byte-level tokenizer, each shared chunk of text once.

Documents are cut where a rolling hash of the last sixteen characters says so, so equal passages are cut
into equal chunks wherever they stand. Chunks meet by key; each is encoded once (one that comes very often once more for
each task that has it often, so that no task gets all its rows), and a document's ids are put together from those of
its chunks. A cut is moved on to the next place at which the tokenizer's splitting
pattern is certain to separate two characters; ids then simply follow each other. Where there is no such
place, the ids around the join are decoded back to the nearest certain places on both sides and encoded
again, so the result is exactly that of encoding the whole text.

Defined cases: null and empty texts have the empty list; texts that spell special tokens are ordinary text;
a document delivered twice comes out once, an id with several texts once for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomill.llm.words import TOKENIZER_DIR, VOCABULARY, encoder, is_joint, token_bytes

WINDOW = 16
CUT_BITS = 9  # one cut in 512 characters
LEAST, MOST, LOOK_ON = 64, 8192, 64
_MULTIPLIER = 0x9E3779B97F4A7C15
_SEEN_MOST = 500_000
OFTEN = 1000  # rows of one chunk in one task from which on it is dealt out
_SLICE_CHARS = 1_000_000


def rolling(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last WINDOW characters at each position, modulo 2**64."""
    h, m, step = codes.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    while step < WINDOW:
        up = h.copy()
        up[step:] += h[:-step] * np.uint64(m)
        h, m, step = up, m * m % 2**64, step * 2
    return h


def cuts(text: str, marked: np.ndarray) -> list[int]:
    """Places to cut, from the places at which the rolling hash asks for one."""
    out, last, n = [], 0, len(text)

    def snap(p: int) -> int:
        for q in range(p, min(p + LOOK_ON, n)):
            if is_joint(text[q - 1], text[q]):
                return q
        return p

    for p in [*marked.tolist(), n]:
        while p - last > MOST:
            last = snap(last + MOST // 2)
            out.append(last)
        if p < n and p - last >= LEAST:
            q = snap(p)
            if q < n:
                out.append(q)
                last = q
    return out


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The chunks of each text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _SLICE_CHARS):
            size += len(texts[j])
            j += 1
        marks = np.flatnonzero(rolling(np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)) >> np.uint64(64 - CUT_BITS) == 0) + 1
        at = 0
        for text in texts[i:j]:
            lo, hi = np.searchsorted(marks, [at + WINDOW, at + len(text)])
            edges = [0, *cuts(text, marks[lo:hi] - at), len(text)]
            yield [text[a:b] for a, b in zip(edges, edges[1:], strict=False)] if text else []
            at += len(text)
        i = j


def _key(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _chunked(often: int) -> Callable:
    """A row for each chunk of each document, in order; one without a key for a document without chunks.

    The text goes with the first row of a chunk in this task. A chunk that comes ``often`` is dealt out: its later
    rows, again with one text, go by the number of the task as well as by the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own_deal = 1 + (task.partitionId() if task else 0)
        seen: dict[bytes, int] = {}
        for b in batches:
            at, pos, certain, keys, deals, texts = [], [], [], [], [], []
            for row, parts in enumerate(chunks([t or "" for t in b.column(1).to_pylist()])):
                for k, part in enumerate(parts or [None]):
                    key = part and _key(part)
                    n = seen[key] = seen.get(key, 0) + 1 if key else 0
                    at.append(row)
                    pos.append(k)
                    certain.append(k == 0 or is_joint(parts[k - 1][-1], part[0]))
                    keys.append(key)
                    deals.append(0 if key and n < often else own_deal)
                    texts.append(part if n in (1, often) else None)
            if len(seen) > _SEEN_MOST:
                seen.clear()
            own = [b.column(c).take(pa.array(at, pa.int32())) for c in (0, 2)]
            types = (pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.string())
            cols = [*own, *[pa.array(c, t) for c, t in zip((pos, certain, keys, deals, texts), types, strict=True)]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "pos", "certain", "key", "deal", "text"])

    return run


def _width(table: list[bytes]) -> str:
    """Numbers as narrow as the vocabulary allows; only for the way between two steps."""
    return "<u2" if len(table) <= 1 << 16 else "<u4"


def _encoded(directory: str, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(directory, name).encode_to_numpy, _width(token_bytes(directory, name))
        last, ids = None, b""
        for b in batches:
            out = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key != last:  # rows come in the order of keys, the one with the text first
                    last, ids = key, encode(text, disallowed_special=()).astype(width).tobytes() if key else b""
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(out, pa.binary())], ["doc_id", "text_hash", "pos", "certain", "ids"])

    return run


def joined(parts: list[tuple[bool, list[int]]], encode: Callable[[str], list[int]], table: list[bytes]) -> list[int]:
    """Ids of a text from (whether the join before it is certain, ids) of its chunks."""

    def sure(a: int, b: int) -> bool:
        x, y = table[a][-1], table[b][0]
        return x < 128 and y < 128 and is_joint(chr(x), chr(y))

    out: list[int] = []
    loose: list[int] = []  # ids after the last certain place before an uncertain join

    def close() -> None:
        if loose:
            out.extend(encode(b"".join(table[i] for i in loose).decode("utf-8")))
            loose.clear()

    for certain, ids in parts:
        if certain:
            close()
            out.extend(ids)
            continue
        if not loose:
            back = len(out) - 1
            while back > 0 and not sure(out[back - 1], out[back]):
                back -= 1
            loose.extend(out[max(back, 0) :])
            del out[max(back, 0) :]
        on = 1
        while on < len(ids) and not sure(ids[on - 1], ids[on]):
            on += 1
        loose.extend(ids[:on])
        if on < len(ids):
            close()
            out.extend(ids[on:])
    close()
    return out


def _assembled(t: pa.Table, encode: Callable[[str], list[int]], table: list[bytes]) -> pa.RecordBatch:
    """Documents from their chunks in order; only those with an uncertain join are looked into."""
    doc = t["doc_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    text, pos = t["text_hash"].to_numpy(), t["pos"].to_numpy()
    new = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
    # A document that was delivered twice has each chunk twice.
    once = np.flatnonzero(new | np.append(True, pos[1:] != pos[:-1]))
    begin = np.flatnonzero(new[once])
    parts = t["ids"].take(pa.array(once)).to_pylist()
    values = np.frombuffer(b"".join(parts), _width(table))
    ends = np.append(0, np.cumsum([len(p) for p in parts])) // values.itemsize
    bounds = np.append(begin, len(once))
    out = [values[ends[a] : ends[b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    certain = t["certain"].to_numpy(zero_copy_only=False)[once]
    for k in np.unique(np.searchsorted(begin, np.flatnonzero(~certain), side="right") - 1):
        own = range(bounds[k], bounds[k + 1])
        out[k] = np.array(joined([(bool(certain[i]), values[ends[i] : ends[i + 1]].tolist()) for i in own], encode, table), np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in out])), pa.int32()), pa.array(np.concatenate(out).astype(np.int32)))
    return pa.RecordBatch.from_arrays([t["doc_id"].take(pa.array(once[begin])).combine_chunks(), lists], ["doc_id", "ids"])


def _documents(directory: str, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = encoder(directory, name).encode_ordinary, token_bytes(directory, name)
        held: list[pa.RecordBatch] = []  # rows of the last document, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            doc, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            n = b.num_rows
            cut_at = next((i for i in range(n - 1, 0, -1) if (doc[i - 1], text[i - 1]) != (doc[n - 1], text[n - 1])), 0)
            if held and (cut_at or (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (doc[0], text[0])):
                ready, held = pa.Table.from_batches([*held, b.slice(0, cut_at)]), [b.slice(cut_at)]
                yield _assembled(ready, encode, table)
            elif cut_at:
                held = [b.slice(cut_at)]
                yield _assembled(pa.Table.from_batches([b.slice(0, cut_at)]), encode, table)
            else:
                held.append(b)
        if held:
            yield _assembled(pa.Table.from_batches(held), encode, table)

    return run


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR, name: str = VOCABULARY, often: int = OFTEN) -> DataFrame:
    """(doc_id, ids) of every document.

    Two shuffles: chunks meet by key, where each is encoded once, and documents meet by id.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    own = f"doc_id {id_type}, text_hash bigint, pos int, certain boolean"
    chunked = (
        docs.select(doc_id, text, F.xxhash64(text).alias("text_hash"))
        .mapInArrow(_chunked(often), f"{own}, key binary, deal int, text string")
    )
    met = chunked.repartition("key", "deal").sortWithinPartitions("key", "deal", F.col("text").isNull())
    encoded = met.mapInArrow(_encoded(directory, name), f"{own}, ids binary")
    whole = encoded.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "pos")
    return whole.mapInArrow(_documents(directory, name), f"doc_id {id_type}, ids array<int>")
