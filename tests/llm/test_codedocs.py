from __future__ import annotations

import pytest

from chronomill.llm import codedocs as C

PY = '''#!/usr/bin/env python
# A module comment of more than five words here.

def plain(a, b):
    """Return the sum of both given values."""
    return a + b


# Count how often a row was seen
# before it expired in the cache.
@decorated(
    1,
)
async def commented(x):
    text = "# not a comment at all, just text"
    return x


# A comment with a blank line below it, so not documentation.

def bare():
    "" f"not a docstring {1}"


class Outer:
    """A class is not a function, whatever it says."""

    def method(self):
        r"""Keep the inner one out of this, please."""

        def inner():
            # Belongs to nobody, as a body comment does.
            return 1

        # Yield the entries, oldest first, as they came.
        def told(): return 2

    x = 1  # a trailing comment of five words or more
    def after_trailing(self): pass


def todo_fn():
    """TODO: write down what this one really does."""


def few():
    """Only four words here."""


def load_the_big_file_now():
    """Load the big file now. Now! The file."""


def empty_doc():
    """   """


# def dead(items):
#     """Return nothing at all, it is dead code."""
def alive(): ...
'''


def docs(path, text):
    return {s.name: s.doc for s in C.symbols(path, text) if s.doc is not None and not C.is_trivial(s.doc, s.name)}


def test_python():
    got = docs("a.py", PY)
    assert set(got) == {"plain", "commented", "Outer.method", "Outer.method.told", "alive"}
    assert got["commented"].split() == "Count how often a row was seen before it expired in the cache.".split()


@pytest.mark.parametrize("text", ["def broken(:\n    pass", "print 'python two'", "x = (", "\0", None, ""])
def test_no_python(text):
    assert C.symbols("a.py", text or "") == []


def test_line_ends_and_marks():
    for form in (PY, PY.replace("\n", "\r\n"), "﻿" + PY, PY.replace("\n", "\r")):
        assert set(docs("a.py", form)) == {"plain", "commented", "Outer.method", "Outer.method.told", "alive"}


JS = r"""
'use strict';
/** Raise ValueError when the shard has no payload. */
async function first(items) { return `text ${items.map(function named(x) { return "}"; })} /* no */ function fake() {}`; }

// Count how often a cache was seen
// before it expired again here.
export default function* second({ a, b = "function no() {}" }, ...rest) {
  /* Return the inner value of the outer one. */
  function inner() { return /[/}"]function x() {/.test(a); }
}

/** A blank line follows this comment, so it documents nothing. */

function bare() {}

class Box extends Base {
  #size = 1;
  handler = (e) => { return e; };
  /**
   * Keep the size of this box as it is.
   * @param n the number
   */
  static async grow(n) { if (n) { return n; } while (n) { n--; } }

  /** Tell what is inside of the box now. */
  get inside() { return this.#size; }

  // Private things have a name as well here.
  #hidden() { class Deep {
    // The method of a class inside of a method.
    run() {}
  } }
  constructor() { super(); }
}
const s = "/** Keep every word of this text. */ function fake2(items) {}";
/** An expression is not a declaration of anything. */
const f = function expr() {
  // But what it declares inside is a function still.
  function within() {}
};
/** TODO describe the shape of the result here */
function later() {}
/** Merge batch now, merge! Now, batch... merge */
function merge_batch_now() {}
"""


def test_javascript():
    got = docs("b.js", JS)
    assert set(got) == {"first", "second", "second.inner", "Box.grow", "Box.inside", "Box.hidden", "Box.hidden.Deep.run", "expr.within"}
    names = {s.name for s in C.symbols("b.js", JS)}
    assert {"bare", "Box.constructor", "later", "merge_batch_now"} <= names and not names & {"fake", "fake2", "x", "no", "Box.handler", "Box.if", "expr", "named"}


def test_javascript_long_decorators():
    for n in (3, 150, 5000):
        text = "class A {\n  // Keep the size of this box as it is.\n  @plain\n  @options([" + ", ".join(map(str, range(n))) + "])\n  sized(x) { return x; }\n}\n"
        assert set(docs("a.js", text)) == {"A.sized"}


def test_other_files_give_nothing():
    assert C.symbols("a.md", PY) == [] and C.symbols("a.PY", PY) == []


TASKS = "task_id string, initial_workspace map<string,string>, workspace_transition map<string,string>, path string, side string"


def test_tables(spark):
    doc = 'def f(x):\n    """Return the value of x, unchanged."""\n    return x\n'
    bare = "def f(x):\n    return x\n"
    stub = 'def g(a):\n    """Tell how large the given thing is."""\n    ...\n'
    impl = "def g(a):\n    return len(a)\n"
    rows = [
        ("t1", {"a.py": doc, "a.txt": doc, "n.py": None}, {"a.py": bare}, "", ""),
        ("t1", {"a.py": doc, "a.txt": doc, "n.py": None}, {"a.py": bare}, "", ""),
        ("t2", None, {"x.py": stub, "y.py": impl, "z.py": doc + doc.replace("unchanged", "as it is now")}, "", ""),
        ("t3", {}, None, "", ""),
    ]
    df = spark.createDataFrame(rows, TASKS)
    assert sorted(map(tuple, C.found(df).collect())) == [("t1", "initial", "a.py", "f"), ("t2", "transition", "x.py", "g"), ("t2", "transition", "z.py", "f")]
    lent = C.pairs(df).where("doc_path <> path").collect()
    assert [(r.path, r.doc_path, r.doc, r.code) for r in lent] == [("y.py", "x.py", "Tell how large the given thing is.", "def g(a):\n    return len(a)")]
    assert C.found(df.limit(0)).count() == 0


def test_overloads_are_resolved_by_signatures(spark):
    pyi = (
        'def f(x: int) -> int:\n    """Add one to a whole number given."""\n    ...\n'
        'def f(x: str) -> str:\n    """Add a mark to the text given."""\n    ...\n'
        'class A:\n    def m(self, *, k: int = 1) -> None:\n        """Tell the large one what to do."""\n'
    )
    impl = "def f(x):\n    return x\nclass A:\n    def m(self, *, k=1):\n        pass\n    def n(self): return 1\n"
    typed = "def f(x: str):\n    return x + '!'\n"
    dts = "/** Merge both of the given lists of names. */\nexport declare function merge(a: string[], b: Map<string, number>): string[];\nexport declare class Box {\n  /** Put one more thing into this box. */\n  put(x: number): void;\n  take(): number;\n}\n"
    js = "export function merge(a, b) { return a; }\nclass Box { put(x) { return x; } take() { return 1; } }\n"
    df = spark.createDataFrame([("t", {"m.pyi": pyi, "m.py": impl + "    def m2(self): pass\n", "n.py": typed, "b.d.ts": dts, "b.js": js}, None, "", "")] * 2, TASKS)
    got = sorted((r.path, r.function_name, C.words(r.doc)[1]) for r in C.pairs(df).where("doc_path <> path").collect())
    # The body of A.m is a mere 'pass', so it is a declaration itself.
    assert got == [("b.js", "Box.put", "one"), ("b.js", "merge", "both"), ("m.py", "f", "a"), ("m.py", "f", "one"), ("n.py", "f", "a")]
    assert {(r.path, r.function_name) for r in C.pairs(df).where("doc_path = path").collect()} == {("m.pyi", "f"), ("m.pyi", "A.m"), ("b.d.ts", "merge"), ("b.d.ts", "Box.put")}
    assert C.found(df).count() == 0


def test_signatures_keep_types_and_kinds():
    (s,) = C.symbols("a.py", "class A:\n  def g(self, a, /, b: 'int', *args, c=1, **kw): return 1")
    assert (s.shape, s.signature) == ("a,b,*args,c,**kw", "a,b:int,*args,c,**kw")
    assert [s.signature for s in C.symbols("a.js", "function f({ a, b = 1 }, ...rest) { return 1; }")] == ["{,...rest"]
