from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from chronomill import plans
from chronomill.functions import code
from chronomill.functions import text as tx
from chronomill.sources import readers, writers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "Hé_1 x-Y2", lambda c: tx.tokens(c)) == ["hé_1", "x", "y2"]
    assert one(spark, "a, b_c!", lambda c: tx.simple_tokens(c)) == ["a", ",", "b_c", "!"]
    assert one(spark, " a\xa0 b\n", lambda c: tx.normal_space(c)) == "a b"
    assert one(spark, " 'mod.K.f()' ", lambda c: tx.short_symbol(F.replace(c, F.lit("'"), F.lit("")))) == "f"
    assert one(spark, "x ```python\na\n``` y ```python\nlonger\n```", lambda c: tx.longest(tx.fenced(c))) == "longer"
    assert one(spark, "3.8.3 or later but less than 3.8", lambda c: tx.impossible_range(c)) is True
    assert one(spark, "3.7 or later but less than 3.8", lambda c: tx.impossible_range(c)) is False
    assert one(spark, "It always returns True", lambda c: tx.always_contradicted(c, F.lit("return False"))) is True
    assert one(spark, "0\n1\n2\nhit\n4", lambda c: tx.excerpt(c, F.lit("hit"), 1, 1)) == "2\nhit\n4"
    assert one(spark, "nothing", lambda c: tx.excerpt(c, F.lit("hit"))) is None
    assert one(spark, "https://h/o/r/pull/12/files", lambda c: tx.issue_number(c)) == 12
    assert one(spark, None, lambda c: tx.fingerprint(c)) != one(spark, "", lambda c: tx.fingerprint(c))


SOURCE = '''
import pkg.mod
import pkg.mod as pm
from old.place import thing as t, other

def f(a, *, b=1):
    """Deprecated: use g."""
    return pkg.mod.stale(a)

class K:
    size = 1
    def m(self): return getattr(pm, "gone")

def __getattr__(name):
    if name == "hooked":
        warnings.warn("x")

t(1, flag=True, items=[])
'''


def test_digests_ignore_layout_and_comments():
    a = {r[0]: r[3] for r in code.digests(SOURCE)}
    b = {r[0]: r[3] for r in code.digests("# note\n" + SOURCE.replace("size = 1", "size   =   1"))}
    assert a == b and {"f", "K", "K.size", "K.m"} <= set(a)
    c = {r[0]: r[3] for r in code.digests(SOURCE.replace("size = 1", "size = 2"))}
    assert c["f"] == a["f"] and c["K.m"] == a["K.m"] and c["K.size"] != a["K.size"] and c["K"] != a["K"]
    assert code.digests("def broken(:") == [] == code.digests(None)


def use(spark, source, symbols, keywords=None):
    df = spark.createDataFrame([("k", source, symbols, keywords)], "k string, src string, names array<string>, kws array<struct<name:string,value:string,value_type:string>>")
    r = code.deprecated_use(df, "k", "src", "names", "kws" if keywords else None).first()
    return r.active, r.mention


@pytest.mark.parametrize(
    "source,symbols,want",
    [
        ("from old.place import thing\nthing()", ["old.place.thing"], (True, False)),
        ("import old.place\nold.place.thing()", ["old.place.thing"], (True, False)),
        ("import old.place as p\np.thing()", ["old.place.thing"], (True, False)),
        ("import old.place as p\ngetattr(p, 'thing')", ["old.place.thing"], (True, False)),
        ("# thing is old\nx = 1", ["old.place.thing"], (False, True)),
        ('"""about thing"""', ["old.place.thing"], (False, True)),
        ("def thing(): pass\nthing()", ["old.place.thing"], (False, False)),
        ("x.thing", ["thing"], (True, False)),
        ("f(thing=1)", ["thing"], (True, False)),
        ("x.thing", ["thing", "a.b"], (False, False)),
        ("from old.place import thing\n(", ["old.place.thing"], (True, False)),
        (None, ["a"], (False, False)),
        ("x = 1", None, (False, False)),
    ],
)
def test_deprecated_use(spark, source, symbols, want):
    assert use(spark, source, symbols) == want


def test_deprecated_keywords(spark):
    assert use(spark, "f(old=True)", [], [("old", "True", None)]) == (True, False)
    assert use(spark, "f(old=False)", [], [("old", "True", None)]) == (False, False)
    assert use(spark, "f(old=set())", [], [("old", None, "empty_collection")]) == (True, False)
    assert use(spark, "f(old=[1])", [], [("old", None, "empty_collection")]) == (False, False)


def test_api_changes_and_resolution(spark):
    df = spark.createDataFrame([("k", SOURCE, SOURCE.replace("def f(a, *, b=1)", "def f(a, c)").replace("class K", "class L"))], "k string, a string, b string")
    d = code.symbol_definitions(df, "k", "a")
    got = sorted((r.qualified_name, r.change) for r in code.api_changes(d, code.symbol_definitions(df, "k", "b"), "k").collect())
    assert ("f", "signature") in got and ("K", "removed") in got and ("L.m", "added") in got and ("f", "deprecated") in got
    wanted = spark.createDataFrame([("k", s) for s in ("f", "hooked", "nothing", "b", "not a name")], "k string, symbol string")
    assert {r.symbol: r.resolution for r in code.resolved(wanted, d, "k").collect()} == {
        "f": "UNIQUE_PASS", "hooked": "UNIQUE_PASS", "nothing": "SYMBOL_NOT_FOUND", "b": "UNIQUE_PASS", "not a name": "NON_AST_SYMBOL",
    }


def test_api_changes_of_deleted_and_new_files(spark, tmp_path):
    one, two = "def f(a):\n    pass\n", "def f(a, b):\n    pass\n"
    rows = [("t", {"gone.py": "class K:\n    def m(self): pass\n", "same.py": one, "kept.py": one, "gone.md": one}, {"gone.py": None, "new.py": one, "same.py": two, "gone.md": None, "never.py": None}), ("u", {"a.py": one}, None)]
    spark.createDataFrame(rows, "task_id string, initial_workspace map<string,string>, workspace_transition map<string,string>").write.parquet(f"{tmp_path}/task_environments.parquet")
    assert sorted(map(tuple, plans.queries()["api_changes"](spark, str(tmp_path)).select("file_key", "qualified_name", "change").collect())) == [
        ("t#gone.py", "K", "removed"), ("t#gone.py", "K.m", "removed"), ("t#new.py", "f", "added"), ("t#same.py", "f", "signature"),
    ]


def test_solution_overlap(spark):
    body = "def g(x):\n    value = compute_all(x)\n    return transform(value, deep=True)\n"
    c = spark.createDataFrame([("a", "before\n value = compute_all(x)\n\n return transform(value, deep=True) after"), ("b", "else")], "k string, context string")
    s = spark.createDataFrame([("a", body), ("b", body)], "k string, solution string")
    assert {r.k: r.near_solution for r in code.solution_overlap(c, s, "k").collect()} == {"a": True, "b": False}


def test_json_sources_and_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("a", 1.0, float("inf")), ("b", 2.0, 5.0)], "memory_id string, valid_from double, valid_to double")
    writers.append_log(df, log)
    writers.append_log(df.limit(1), log)
    back = readers.records_json(spark, log)
    assert back.count() == 3 and back.where("valid_to = double('Infinity')").count() >= 1 and back.where("valid_to = 5").count() == 1
    assert readers.json_lines(spark, str(tmp_path / "none"), "x int").count() == 0
    for k in ("one", "two"):
        (tmp_path / f"{k}.json").write_text(json.dumps({"v": k}, indent=1))
    assert sorted(map(tuple, readers.json_by_key(spark, str(tmp_path), "v string").collect())) == [("one", "one"), ("two", "two")]
    writers.write_metrics(spark.createDataFrame([(3, 0.5)], "n int, tsr double"), str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text()) == {"n": 3, "tsr": 0.5}
    assert "| a\\|b |" in writers.markdown(spark.createDataFrame([("a|b",)], "x string"))
    with pytest.raises(ValueError, match="more than"):
        writers.markdown(spark.range(5), 3)


def test_trees_manifests_and_exports(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.txt").write_bytes(b"A")
    (tmp_path / "t" / "sub" / "b.txt").write_bytes(b"BB")
    t = readers.tree(spark, str(tmp_path / "t"))
    assert sorted((r.path, r.size) for r in t.collect()) == [("a.txt", 1), ("sub/b.txt", 2)]
    m = readers.manifest(t).first()
    assert (m.n_files, m.n_bytes, len(m.tree_sha256)) == (2, 3, 64)
    over = spark.createDataFrame([("a.txt", 9)], "path string, size bigint")
    assert {r.path: r.size for r in readers.layered([t.select("path", "size"), over]).collect()} == {"a.txt": 9, "sub/b.txt": 2}
    rows = spark.createDataFrame([("core", 1), ("control", 2), ("rebuild", 3)], "role string, x int")
    writers.export_by(rows, "role", F.col("role") != "rebuild", str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["role=control", "role=core"]
    assert {r.role: r.x for r in writers.upsert(rows, spark.createDataFrame([("core", 7)], "role string, x int"), "role", "x").collect()}["core"] == 7


def test_change_log_diff_and_database(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(b"c1\x00p1 p2\x00Remove old API\x00body\x1e\nc2\x00p3\x00Tidy\x00\x1ebad\x1e")
    got = readers.change_log(spark, str(tmp_path / "log.txt")).collect()
    assert [(r.commit, r.parents, r.subject) for r in got] == [("c1", ["p1", "p2"], "Remove old API")]
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n@@ -9 +9 @@\n c\n+d\ndiff --git a/y.py b/y.py\n@@ -1 +1 @@\n-z\n"
    h = readers.hunks(spark.createDataFrame([(1, diff)], "id int, d string"), "id", "d").orderBy("hunk_no").collect()
    assert [(r.file, r.n_added, r.n_removed) for r in h] == [("x.py", 1, 1), ("x.py", 1, 0), ("y.py", 0, 1)]
    db = tmp_path / "s.db"
    with sqlite3.connect(db) as c:
        c.execute("create table r (id text, n int)")
        c.execute("insert into r values ('a', 1)")
    assert [tuple(r) for r in readers.sqlite_table(spark, str(db), "r", "id string, n bigint").collect()] == [("a", 1)]
    (tmp_path / "c.json").write_text('{"k1": 1.5}')
    assert readers.configuration(str(tmp_path / "c.json")) == {"k1": 1.5}
    assert readers.canonical_digest({"b": 1, "a": 2}) == readers.canonical_digest({"a": 2, "b": 1})


@pytest.mark.parametrize(
    "source,symbols,want",
    [
        ("DEFAULT_TTL = 60", ["DEFAULT_TTL"], (True, False)),
        ("def f(c):\n    return c.DEFAULT_TTL", ["DEFAULT_TTL"], (True, False)),
        ("initialize(ttl=300)", ["ttl"], (True, False)),
        ('h = {}\nh["X-Some-Token"] = 1', ["X-Some-Token"], (True, False)),
        ('a = "HS256"', ["HS256"], (True, False)),
        ('if p == "TTL":\n    pass', ["TTL"], (True, False)),
        ('x = cfg["method_whitelist"]', ["pkg.method_whitelist"], (True, False)),
        ("method_whitelist = 3", ["method_whitelist"], (True, False)),
        ("from a import b as old", ["old"], (True, False)),
        ("def old(): pass", ["m.old"], (True, False)),
        ('"""Tells of old things."""\n# and old ones', ["old"], (False, True)),
        ('x = "xy"', ["x y", "xyz"], (False, False)),
        ('x = broken(\nold = 1', ["old"], (True, False)),
        ('broken(\nx["old"]\n# old', ["old"], (True, True)),
        ("broken(\nfine = 1", ["old"], (False, False)),
        (None, ["old"], (False, False)),
        ("x = 1", [None, ""], (False, False)),
    ],
)
def test_stale_names(spark, source, symbols, want):
    df = spark.createDataFrame([("k", source, symbols)], "k string, src string, names array<string>")
    r = code.stale_names(df, "k", "src", "names").first()
    assert (r.active, r.mention) == want


def test_signatures_have_all_kinds_and_defaults():
    (row,) = [r for r in code.definitions("def g(a, /, b: int = 2, *args, c=1, d, **kw): pass") if r[1] == "function"]
    assert row[2] == "a, /, b=2, *args, c=1, d, **kw"
    assert code.definitions("def g(a, *, k): pass")[0][2] == "a, *, k" and code.definitions("def g(): pass")[0][2] == ""


def test_long_diffs_keep_source_files_first(spark):
    part = lambda path, n: f"diff --git a/{path} b/{path}\n" + "\n".join(f"+{path} line {k}" for k in range(n))
    diff = "\n".join([part("docs/a.md", 20), part("src/x.py", 10), part("README.md", 20), part("lib/src/y.py", 5)])
    code_lines = "\n".join([part("src/x.py", 10), part("lib/src/y.py", 5)])
    rows = [(1, diff), (2, "short"), (3, None), (4, part("docs/b.md", 99))]
    df = spark.createDataFrame(rows, "k bigint, d string")
    got = {r.k: r.diff for r in readers.truncated_diffs(df, "k", "d", most=len(code_lines) + 60, least_rest=50).collect()}
    assert got[1] == code_lines + "\n" + "\n".join([part("docs/a.md", 20), part("README.md", 20)])[:60]
    assert got[2] == "short" and got[3] is None and got[4] == "\n" + part("docs/b.md", 99)[: len(code_lines) + 60]
    tight = {r.k: r.diff for r in readers.truncated_diffs(df, "k", "d", most=len(code_lines) + 40, least_rest=50).collect()}
    assert tight[1] == code_lines
