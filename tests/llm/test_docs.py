from datetime import datetime

import pytest

from codeloom.llm.docs import bare_documentation, documented_functions, is_informative, parse_unit, parse_units
from codeloom.llm.peg import Grammar


def test_grammar_choice_repetition_predicates_and_offsets():
    g = Grammar(
        r"""
        sum   <- term (plus term)* !any
        term  <- number / '(' sum_in ')'
        sum_in <- term (plus term)*
        plus  <- ~" *\+ *"
        number <- ~"\d+"
        any <- ~"."
        """
    )
    tree = g.parse("1 + (2+33)")
    assert tree.find("sum_in").find("number").begin == 5 and tree.end == 10
    assert g.parse("1 + ") is None and g.parse("") is None


UNITS = {
    "python": ('@dec("(")\nasync def f(a, b="):", *c) -> int:\n    """Says more than that."""\n    return 1\n', "f", ["Says more than that."]),
    "java": ("/**\n * Reads the rows.\n * @param x the rows\n */\n@Override\npublic static <T> List<String> read(int x) {\n}\n", "read", ["Reads the rows.", "@param x the rows"]),
    "typescript": ("// eslint-disable-next-line\n/** Opens it. */\n  async open(path: string) {\n", "open", ["Opens it."]),
    "javascript": ("/** Adds. */\nexport const add = (a, b) => a + b;\n", "add", ["Adds."]),
    "go": ("// Walk visits every node.\n// old = walk(tree)\nfunc (s *Store) Walk(n int) error {\n", "Walk", ["Walk visits every node."]),
}


@pytest.mark.parametrize("language", list(UNITS))
def test_units_of_every_language(language):
    text, name, lines = UNITS[language]
    got = parse_unit(text, language)
    assert got[0] == name and got[2] == lines
    assert parse_unit("class X {}\n", language) is None and parse_unit("", language) is None


FILES = {
    "python": ('"""Tool."""\nimport os\nX = """\ndef not_one():\n    pass\n"""\n\n# Adds two numbers.\ndef add(a, b):\n    return a + b\n\nclass K:\n    def get(self):\n        """Gets the row."""\n        def inner():\n            return foo(1)\n',
               [("add", ["Adds two numbers."]), ("get", ["Gets the row."]), ("inner", [])]),
    "java": ("class A {\n  private int size = of(3);\n  /** Reads the rows. */\n  public int read(String x) throws E {\n    if (x == null) {\n      return call(x);\n    }\n    call(x);\n  }\n  // Makes it.\n  A(int n) {\n  }\n  int last();\n}\n",
             [("read", ["Reads the rows."]), ("A", ["Makes it."]), ("last", [])]),
    "typescript": ("export class A {\n  /** Opens the store. */\n  async open(path: string): Promise<void> {\n    if (path) {\n      describe('x', () => {\n        run(path);\n      });\n    }\n  }\n}\n// Doubles a value.\nexport const twice = x => x * 2;\n",
                   [("open", ["Opens the store."]), ("twice", ["Doubles a value."])]),
    "go": ("package x\n\n// Walk visits every node.\nfunc (s *S) Walk() {\n  go func() { }()\n}\n", [("Walk", ["Walk visits every node."])]),
    "kotlin": ("class A {\n  /** Reads the rows. */\n  override fun read(x: Int): Int = x\n}\n", [("read", ["Reads the rows."])]),
    "rust": ("use x;\n/// Reads the rows.\n#[inline]\npub fn read(x: u8) -> u8 { x }\n", [("read", ["Reads the rows."])]),
    "php": ("<?php\n/** Reads the rows. */\npublic static function read($x) {\n}\n", [("read", ["Reads the rows."])]),
    "c": ("#include <x.h>\n/* Reads the rows. */\nstatic int *read(const char *x) {\n  return f(x);\n}\n", [("read", ["Reads the rows."])]),
    "ruby": ("class A\n  # Reads the rows.\n  def read!(x)\n  end\nend\n", [("read!", ["Reads the rows."])]),
}


@pytest.mark.parametrize("language", list(FILES))
def test_every_function_of_a_file(language):
    text, want = FILES[language]
    got = parse_units(text, language)
    assert [(u.name, list(u.lines)) for u in got] == want
    assert all(text[u.declared :].lstrip().split("(")[0].split()[0] for u in got)


@pytest.mark.parametrize(
    "text", ["", "   ", "---", "TODO", "todo: document", "(non-Javadoc)", "{@inheritDoc}", "@return", ":param value:\n:return:", "See above.", "n/a", "...", "/** Auto-generated method stub */",
             "Build index.", "The build index method.", "buildIndex()", "/** noinspection */", "# noqa: E501", "SPDX-License-Identifier: x", "x = build(y)"],
)
def test_trivial_documentation(text):
    assert not is_informative(bare_documentation(text), "buildIndex")


@pytest.mark.parametrize("text", ["Builds the index of all rows.", "Ein Filter liest die Tabelle.", "@return the rows that are left", "Sorts the record to 188.", '"""Links a node."""'])
def test_informative_documentation(text):
    assert is_informative(bare_documentation(text), "buildIndex")


def test_constructors_know_their_class():
    assert not is_informative(["Grammar node."], "__init__", "GrammarNode") and not is_informative(["__init__()"], "__init__", "X")


SYMBOLS = "id long, fqn string, name string, kind string, file_path string, line_start int, docstring string, updated_at timestamp, code string"
CHUNKS = "id long, fqn string, file_path string, line_start int, language string, content string, content_type string, updated_at timestamp, symbol long"
T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def test_pairs_come_from_both_places_and_newest_rows(spark):
    symbols = [
        (1, "a.py::f", "f", "function", "a.py", 1, None, T1, "x"), (2, "a.py::g", "g", "function", "a.py", 9, "Gives the rows.", T1, None), (3, "a.py::h", "h", "method", "a.py", 20, "TODO", T1, None),
        (4, "a.py::C", "C", "class", "a.py", 30, "A class of its own.", T1, None), (5, "a.py::k", "k", "function", "a.py", 41, None, T1, None), (6, "a.py::m", "m", "function", "a.py", 51, "Old words.", T1, None),
        (6, "a.py::m", "m", "function", "a.py", 51, None, T2, None), (7, None, None, "function", None, None, None, None, None),
    ]
    chunks = [
        (10, "a.py::f", "a.py", 1, "python", 'def f():\n    """Finds the row."""\n', "code", T1, 0), (11, "a.py::g", "a.py", 9, None, "def g():\n    pass\n", "code", T1, 0),
        (12, "a.py::h", "a.py", 20, "python", "def h(self):\n    pass\n", "code", T1, 0), (13, "a.py::C", "a.py", 30, "python", "class C:\n    pass\n", "code", T1, 0),
        (14, None, "a.py", 40, "python", '@x\ndef k():\n    """Keeps the row."""\n', "code", T1, 0), (15, "a.py::m", "a.py", 51, "python", "def m():\n    pass\n", "code", T1, 0),
        (10, "a.py::f", "a.py", 1, "python", 'def f():\n    """Finds the row."""\n', "code", T1, 0), (16, None, None, None, None, None, "code", None, None),
    ]
    s, c = spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(chunks, CHUNKS)
    got = sorted((r["symbol"], r["chunk"], r["documentation"]) for r in documented_functions(s, c).collect())
    assert got == [(1, 10, "Finds the row."), (2, 11, "Gives the rows."), (5, 14, "Keeps the row.")]
    inner = spark.createDataFrame([(20, "a.py::C", "a.py", 30, "python", 'class C:\n    x = 1\n    def k(self):\n        """Keeps more rows."""\n    def z(self):\n        """Of no symbol."""\n', "code", T1, 0)], CHUNKS)
    at = s.unionByName(spark.createDataFrame([(8, "a.py::C.k", "k", "method", "a.py", 32, None, T1, None)], SYMBOLS))
    found = {(r["symbol"], r["name"], r["own"], r["documentation"], r["code"].split("(")[0].strip()) for r in documented_functions(at, inner).collect()}
    assert found == {(8, "k", False, "Keeps more rows.", "def k"), (None, "z", False, "Of no symbol.", "def z")}
    assert documented_functions(s.where("false"), c).where("symbol is not null").count() == 0 and documented_functions(s, c.where("false")).count() == 0


def test_very_long_texts_parse_in_linear_time():
    text = "/** " + "word " * 200_000 + "*/\nfunction f() {\n"
    assert parse_unit(text, "javascript")[0] == "f"
