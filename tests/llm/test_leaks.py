from __future__ import annotations

import random

import numpy as np

from chronomill.llm import leaks as L
from chronomill.llm.words import words

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string, split string, doc_id string"


def brute(docs, items, n=L.WINDOW):
    out = set()
    for d, t in docs:
        w = words(t)
        mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, s in items:
            v = words(s)
            if any(tuple(v[k : k + n]) in mine for k in range(len(v) - n + 1)):
                out.add((d, i))
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "dev", "x") for r in items], ITEMS)
    return L.leaks(d, i, **kw)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = "the of a file when record must not route 12 345 ms lock queue policy".split()
    items = [(k, " ".join(rng.choice([*vocabulary, f"name{k}{j}"]) for j in range(rng.randint(5, 40)))) for k in range(25)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "…")]
    for k in range(4, 90):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        src = words(rng.choice(items)[1])
        at, n = rng.randint(0, len(src)), rng.choice([5, 11, 12, 13, 30])
        w[rng.randint(0, len(w)) : 0] = src[at : at + n]
        docs.append((k, rng.choice([" ", "_", " -- ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    return docs, items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = cases(seed)
        want = brute(docs, items)
        got = run(spark, docs, items)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want and want
        # A filter far too small lets more windows through, but the join decides.
        assert sorted((r.doc_id, r.item_id) for r in run(spark, docs, items, most_bits=64).collect()) == want


def tables(spark, docs, items):
    return spark.createDataFrame([(*r, "x") for r in docs], DOCS), spark.createDataFrame([(*r, "dev", "x") for r in items], ITEMS)


def test_templates_with_other_parameters(spark):
    items = [(k, f"After the {a} handoff agent {b} recalls that {c} still accepts {n} {d} arguments today") for k, (a, b, c, n, d) in enumerate([("zor", "kif", "mup", 12, "lat"), ("wex", "bin", "sol", 77, "tir"), ("qua", "rez", "nim", 5, "hod")])]
    docs = [
        (1, "After the foo handoff agent bar recalls that baz still accepts 99 qux arguments today"),
        (2, "After the foo handoff agent foo recalls that baz still accepts 99 qux arguments today"),
        (3, items[0][1].replace("_", " ").upper()),
        (4, "After the foo handoff agent bar recalls that baz never accepts 99 qux arguments today"),
    ]
    held, members = L.templates(*tables(spark, docs, items))
    # Of four windows, three hold both places of the second text's inconsistent name. All items have one template.
    assert {tuple(r) for r in held.collect()} == {(1, 0, 4, 0), (2, 0, 1, 0), (3, 0, 4, 4)}
    assert {tuple(r) for r in members.collect()} == {(0, 0), (0, 1), (0, 2)}


COMMON = "after the handoff agent recalls that still accepts arguments although diff dropped two commits earlier so a memory bound to is neither current nor fully wrong which record should trust about given expired".split()


def planted(seed, n_items):
    """Items of common words and slots, and documents with an item's words under other numbers and names."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    shapes = [[rng.choice([*COMMON, *COMMON, None, 0]) for _ in range(24)] for _ in range(n_items)]
    fill = lambda shape: " ".join(name() if x is None else str(rng.randint(3, 5000)) if x == 0 else x for x in shape)
    items = [(k, fill(shape)) for k, shape in enumerate(shapes)]
    noise = [(1000 + k, " ".join(rng.choice(COMMON) if rng.random() < 0.6 else name() for _ in range(60))) for k in range(400)]
    leaked = [(k, " ".join([*(name() for _ in range(rng.randint(0, 9))), fill(shapes[k % n_items]), name()])) for k in range(60)]
    return [*leaked, *noise], items


def test_recall_of_texts_with_other_parameters(spark):
    # One item alone as well: template words are those of the corpus.
    for n_items in (1, 30):
        docs, items = planted(n_items, n_items)
        held, members = L.templates(*tables(spark, docs, items))
        found = {(r.doc_id, r.item_id) for r in held.join(members, "template_id").collect()}
        want = {(k, k % n_items) for k in range(60)}
        assert len(found & want) >= 0.9 * len(want) and {d for d, _ in found} <= set(range(60))


def test_many_items_on_one_template_are_one_row(spark):
    items = [(k, f"After the x{k}a handoff agent y{k}b recalls that z{k}c still accepts {k} w{k}d arguments today") for k in range(300)]
    docs = [(k, f"After the foo{k} handoff agent bar{k} recalls that baz still accepts {k} qux arguments today") for k in range(20)]
    held, members = L.templates(*tables(spark, docs, items))
    assert held.count() == 20 and members.count() == 300 and L.leaks(*tables(spark, docs, items)).count() == 0


def test_keys_agree_with_templates():
    """Windows of one template have one key, so that the filter never keeps a leak from the join."""
    rng = random.Random(5)
    fixed = frozenset("abcdefgh")
    texts = [" ".join(rng.choice([*"abcdefgh", "n1x", "nm", "q", "7", "88"]) for _ in range(rng.randint(10, 40))) for _ in range(300)]
    own, keys = L.Canonical(fixed), {}
    for said, _, place, key in own.slices(texts):
        for p, k in zip(place.tolist(), key.tolist(), strict=True):
            keys.setdefault(L.template_of(said[p : p + L.WINDOW], fixed), set()).add(k)
    assert len(keys) > 1000 and all(len(v) == 1 for v in keys.values())
    some = np.array(sorted({k for v in keys.values() for k in v}), np.uint64)
    bits = np.zeros(1 << 10, np.uint64)
    part = L._partial_bits(some[::2], 1 << 16)
    bits[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    assert set(range(0, len(some), 2)) <= set(L._passes(some, bits).tolist()) and len(L._passes(some, bits)) < 0.6 * len(some)


def test_empty_and_short(spark):
    docs, items = cases(0)
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0
    assert run(spark, docs, [(1, "too few words for any window")]).count() == 0
