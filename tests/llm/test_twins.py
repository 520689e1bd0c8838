from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomill.llm.twins import fields, merkle, twins

SCHEMA = "record_table string, id string, statement string, leaf string, root string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, twins(df).where("keep_id <> copy_id").select("record_table", "keep_id", "copy_id").distinct().collect()))


FORMS = [
    "symbol: a_b; file: src/x.py; limit: 5; owner: tester",
    "owner=TESTER; limit=5; symbol=a_b; file=src/x.py;",
    "  symbol = a_b | limit = 5 | file =\xa0src/x.py | owner = tester",
    '{"limit": 5, "symbol": "a_b", "file": "src/x.py", "owner": "Tester"}',
    '{\n  "owner": "tester",\n  "limit": "5",\n  "file": "src/x.py",\n "symbol": "a_b"\n}',
    "symbol: a_b\r\nowner: tester\r\nfile: src/x.py\r\nlimit: 5\r\n",
    "• symbol: a_b, file: src/x.py, limit: 5, owner: tester",
    "{'symbol': 'a_b', 'limit': 5, 'file': 'src/x.py', 'owner': 'tester'}",
    "symbol a b file src x py limit 5 owner tester",
]


def test_notations_are_one(spark):
    rows = [("t", f"i{k}", s) for k, s in enumerate(FORMS)]
    assert groups(spark, rows) == [("t", "i0", f"i{k}") for k in range(1, len(FORMS))]


def test_values_stay_with_their_names(spark):
    rows = [("t", "a", "owner: coder; backup: tester"), ("t", "b", "owner: tester; backup: coder"), ("t", "c", "backup=tester; owner=coder"), ("u", "d", "backup=tester; owner=coder")]
    assert groups(spark, rows) == [("t", "a", "c")]


def test_word_order_counts_outside_fields(spark):
    rows = [("t", "a", "Call f(x) before g."), ("t", "b", "call F x BEFORE -- g"), ("t", "c", "call g before f(x)"), ("t", "d", None), ("t", "e", "..."), ("t", "f", " "), ("t", "g", None)]
    assert groups(spark, rows) == [("t", "a", "b")]


def test_different_readings_of_the_same_words_join(spark):
    # The same words, split into fields in two ways; each way also has a reordered form.
    rows = [("t", "a", "a b: c; d: e"), ("t", "b", "a: b c; d: e"), ("t", "c", "d: e; a b: c"), ("t", "d", "d: e; a: b c"), ("t", "e", "a b c d e"), ("t", "f", "d e a b c")]
    # e reads as a, b; c is a's fields and d is b's; f has the words of c and d, so all are one.
    assert groups(spark, rows) == [("t", "a", x) for x in "bcdef"]


def test_nested_objects_are_unordered_and_lists_ordered():
    a = merkle('{"x": {"p": 1, "q": 2}, "y": [1, 2]}')
    assert a[2:] == merkle('{"y": [1, 2], "x": {"q": 2, "p": 1}}')[2:]
    assert a[2] != merkle('{"y": [2, 1], "x": {"q": 2, "p": 1}}')[2]
    assert a[2] != merkle('{"y": [1, 2], "x": {"q": 1, "p": 2}}')[2]


@pytest.mark.parametrize("text", ["Reviewer note: x keeps y", "Timeout of f is 9.7 seconds, retries: 8.", "no fields at all", "a: 1", "", "时间：x 在版本 6.1 之后失效，请改用 y。"])
def test_not_fields(text):
    assert fields(text) is None


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("alpha beta gamma delta owner".split()), st.text("abc XY9_/.", min_size=1, max_size=8).filter(lambda v: any(c.isalnum() for c in v)), min_size=2), st.randoms())
def test_order_and_notation_never_matter(pairs, rnd):
    items = list(pairs.items())
    base = merkle("; ".join(f"{k}: {v}" for k, v in items))
    rnd.shuffle(items)
    assert base[2:] == merkle("\n".join(f"{k.upper()} = {v}" for k, v in items))[2:]


def test_counts_rewrites_and_one_hot_text(spark):
    rows = [("t", f"h{k:04d}", random.Random(k).choice(["Same text", "same  TEXT!", "(same) text"])) for k in range(400)] + [("t", f"o{k}", f"other {k}") for k in range(800)]
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = twins(df)
    assert got.where("keep_id = 'h0000'").count() == 400 and got.agg({"n_rows": "sum"}).first()[0] == len(rows)


@pytest.mark.parametrize(("a", "b"), [
    ("level=info msg=ok id=3", "id=3 level=info msg=ok"),
    ('level=info msg="a; b=c" id=3', 'id=3 msg="a; b=c" level=info'),
    ("level=info msg=a,b id=3", "msg=a,b id=3 level=info"),
    ("a=1;b=2 c=3", "c=3 a=1 b=2"),
    ("a: 1 b: 2 at: 10:30", "at: 10:30 b: 2 a: 1"),
    ("one two three four five: x; b: y", "b: y; one two three four five: x"),
    ("first name=Jo; last name=Doe x", "last name=Doe x; first name=Jo"),
    ('k: {"y":2,"x":1}; z: 3', '{"z": 3, "k": {"x": 1, "y": 2}}'),
    ('k: {"y":2,"x":1}, z: 3', "z: 3, k: {'ignored'}".replace("{'ignored'}", '{"x":1,"y":2}')),
    ("<r><a>1</a><b>2</b></r>", "<r><b>2</b> <a>1</a></r>"),
    ('<r a="1" b="2"/>', "<r b='2' a='1' />"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "| b | a |\n| --- | --- |\n| 2 | 1 |"),
    ("a | 1\nb | 2", "b | 2\na | 1"),
    ('[{"a":1,"b":2},{"c":3}]', '[{"b":2,"a":1},{"c":3}]'),
])
def test_fields_in_more_notations(a, b):
    assert merkle(a)[2] is not None and merkle(a)[2:] == merkle(b)[2:]


@pytest.mark.parametrize(("a", "b"), [
    ('[{"a":1},{"b":2}]', '[{"b":2},{"a":1}]'),
    ("10:30, 11:45", "11:45, 10:30"),
    ("[1, 2]", "[2, 1]"),
    ("see http://a/b; ftp://c/d", "see ftp://c/d; http://a/b"),
    ("a=1 b=2", "a=2 b=1"),
    ("<r><a>1</a><b>2</b></r>", "<r><a>2</a><b>1</b></r>"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|\n| 2 | 1 |"),
    ("x | y | z\n1 | 2 | 3", "1 | 2 | 3\nx | y | z"),
])
def test_orders_that_count(a, b):
    assert (merkle(a)[2] or merkle(a)[0]) != (merkle(b)[2] or merkle(b)[0])


def test_empty(spark):
    assert groups(spark, []) == []


def test_one_field_objects_and_endless_nesting(spark):
    rows = [("t", "a", '{"note": "caf\\u00e9 is open"}'), ("t", "b", "note: CAFÉ is open"), ("t", "c", '{"a":' * 3000 + "1" + "}" * 3000), ("t", "d", '{"a": ' * 3000 + "1" + "}" * 3000)]
    assert groups(spark, rows) == [("t", "a", "b"), ("t", "c", "d")]
