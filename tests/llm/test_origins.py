from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.llm.attributes import glob_regex, parse_attributes
from codeloom.llm.origins import _GENERATED, chunk_evidence, file_origins, header_of, header_signs, mined_patterns

T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
SCHEMA = "id long, updated_at timestamp, file_path string, line_start int, content string, content_type string, origin string"


@pytest.mark.parametrize(
    ("glob", "hits", "misses"),
    [("*.pb.go", ["a.pb.go", "x/y/a.pb.go"], ["a.go"]), ("gen/**", ["gen/a", "gen/b/c"], ["x/gen/a"]), ("**/gen/*", ["gen/a", "x/gen/a"], ["gen/b/c"]), ("/top.js", ["top.js"], ["x/top.js"]),
     ("a?[!b].js", ["axc.js"], ["axb.js", "a.js"]), ("docs/*.md", ["docs/a.md"], ["docs/x/a.md"])],
)
def test_globs(glob, hits, misses):
    import re

    assert all(re.search(glob_regex(glob), p) for p in hits) and not any(re.search(glob_regex(glob), p) for p in misses)


def test_attribute_lines():
    text = "# note\n*.js linguist-generated\nlib/** linguist-vendored=true eol=lf\nlib/own/** -linguist-vendored\n*.ts !linguist-generated\n\n"
    assert parse_attributes(text) == [("*.js", "generated", True), ("lib/**", "vendored", True), ("lib/own/**", "vendored", False), ("*.ts", "generated", None)]


HAND = "import { a } from './b';\n\nexport function readRows(index) {\n  return index.filter((x) => x.size > 3);\n}\n"


def test_content_evidence():
    assert chunk_evidence(HAND)[1:] == (0, 0, 0) and chunk_evidence("") == (0, 0, 0, 0)
    assert chunk_evidence("".join(f"  nodeEdge{k}: {{ type: 'int32', id: {k + 1} }},\n" for k in range(9)))[1] == 8
    total, _, literal, _ = chunk_evidence("const a = [\n" + "  0x1a, 0xff, 0x00, 0x2b,\n" * 30 + "];\n")
    assert literal > 0.9 * total
    total, _, _, dense = chunk_evidence('!function(a,b){"use strict";' + "if(!a)return b;var c=d(e,4);" * 40)
    assert dense == total
    assert header_of("// one\n\n/* two */\ncode\n// three") == ["one", "", "two"]


def files(spark, rows):
    return spark.createDataFrame([(k, T1, p, 1, c, t, "clash") for k, (p, c, t) in enumerate(rows)], SCHEMA)


def test_declarations_win_and_deeper_ones_first(spark):
    rows = [
        ("r/.gitattributes", "*.js linguist-generated\nlib/** linguist-vendored\n", "config"), ("r/lib/own/.gitattributes", "* -linguist-vendored\n*.js !linguist-generated\n", "config"),
        ("r/a.js", HAND + "// a\n", "code"), ("r/lib/b.py", HAND + "// b\n", "code"), ("r/lib/own/c.js", HAND + "// c\n", "code"), ("r/d.py", "# Code generated by x. DO NOT EDIT.\nx = 1\n", "code"), ("s/a.js", HAND, "code"), (None, HAND, "code"), ("s/null.py", None, "code"),
    ]
    got = {r["file_path"]: (r["origin"], r["reason"]) for r in file_origins(files(spark, rows)).collect()}
    assert got["r/a.js"] == ("generated", "declared") and got["r/lib/b.py"] == ("vendored", "declared")
    assert got["r/lib/own/c.js"] == (None, None) and got["r/d.py"] == ("generated", "content") and got["s/a.js"] == (None, None) and got["s/null.py"][0] is None
    assert None not in got


@pytest.mark.parametrize("line", ['Writes files that carry a "DO NOT EDIT" line.', "Reads the auto-generated report of the nightly build.", "Generated code is checked by the linter below.", "Auto-generated method stub"])
def test_mentions_are_not_markers(spark, line):
    assert file_origins(files(spark, [("r/a.py", f"# {line}\nx = 1\n", "code")])).collect()[0]["origin"] is None


@pytest.mark.parametrize("line", ["Code generated by protoweave. DO NOT EDIT.", "@generated by x from y", "AUTOGENERATED FILE - do not modify by hand", "Diese Datei wurde von x erzeugt. Nicht bearbeiten.", "Generated from a.schema on build 3", "This file was created automatically by x; changes will be lost."])
def test_markers(spark, line):
    assert file_origins(files(spark, [("r/a.py", f"#\n# {line}\nx = 1\n", "code")])).collect()[0]["origin"] == "generated"


LICENCE = [f"line {k} of the licence that this file is given under" for k in range(40)]


@pytest.mark.parametrize(
    "text",
    ["".join(f"// {x}\n" for x in LICENCE) + "//\n// Code generated by x. DO NOT EDIT.\nx = 1\n", "/*\n" + "\n".join(LICENCE) + "\nCode generated by x. DO NOT EDIT.\n*/\nx = 1;\n",
     '"""\nThe wire tables.\n\nGenerated by x from y.\n"""\nx = 1\n', "<!--\nplain words\n@generated\n-->\n<a/>\n", "/* one */\n\n/*\nCode generated by x.\n*/\ny\n"],
)
def test_headers_are_read_to_their_end(text):
    assert any(_GENERATED.match(x) for x in header_of(text))


def test_headers_end_where_code_begins():
    assert header_of("/* a\nb */ x = 1;\n// c") == ["a", "b */ x = 1;"] and header_of('"""One."""\nx = 1\n"""\n@generated\n"""') == ['One."""']
    assert header_of("x = 1\n// Code generated by x") == [] and header_of("/* never closed\n\nb") == ["never closed", "", "b"] and header_of("") == [""]


def test_copies_of_vendored_files_and_old_rows(spark):
    lib = "// Part of the kelofa distribution, release 2.1.\n" + HAND * 3
    rows = [("r/deps/kelofa/x.js", lib, "code"), ("s/src/y.js", lib.replace("\n", "\r\n"), "code"), ("s/src/own.js", HAND + "// ours\n", "code"), ("t/vendor/z/z.js", HAND * 2, "code"), ("t/core/q.js", HAND * 2, "code")]
    df = files(spark, rows).unionByName(spark.createDataFrame([(2, T2, "s/src/own.js", 1, lib, "code", "x")], SCHEMA))
    got = {r["file_path"]: r["origin"] for r in file_origins(df).collect()}
    assert got == {"r/deps/kelofa/x.js": "vendored", "s/src/y.js": "vendored", "s/src/own.js": "vendored", "t/vendor/z/z.js": "vendored", "t/core/q.js": "vendored"}


def test_patterns_are_mined_over_repositories(spark):
    rows = [(f"r{k % 4}/deps/p{k}/f.js", f"r{k % 4}", False, k % 5 != 0) for k in range(60)] + [(f"r{k % 4}/src/p{k}/f.js", f"r{k % 4}", False, k % 9 == 0) for k in range(60)]
    got = {(r["glob"], r["kind"]) for r in mined_patterns(spark.createDataFrame(rows, "file_path string, repo string, made boolean, taken boolean")).collect()}
    assert ("**/deps/**", "vendored") in got and not any("src" in g for g, _ in got) and not any(k == "generated" for _, k in got)


def test_repositories_are_counted_exactly(spark):
    pairs = spark.range(3000).selectExpr("id", "explode(array(concat('a', id), concat('b', id))) as repo")
    twins = pairs.groupBy("id").agg(F.approx_count_distinct("repo").alias("n")).where("n < 2").collect()
    assert twins
    rows = [(f"{x}{twins[0]['id']}/deps/p{k}/f.js", f"{x}{twins[0]['id']}", False, True) for x in "ab" for k in range(20)]
    got = mined_patterns(spark.createDataFrame(rows, "file_path string, repo string, made boolean, taken boolean")).collect()
    assert ("**/deps/**", "vendored", 2) in {(r["glob"], r["kind"], r["repos"]) for r in got}


def test_empty_table(spark):
    assert file_origins(files(spark, [("x", "y", "code")]).where("false")).count() == 0


def test_headers_are_mined_where_no_phrase_names_a_project(spark):
    """A plain copyright line in usual vendored places becomes a pattern for files elsewhere."""
    jane = lambda k: f"// Copyright (c) 2019 Jane Doe\nexport const part{chr(97 + k)} = read({k} + 1);\n"
    rows = [(f"r{k % 6}/third_party/jane/f{k}.js", jane(k), "code") for k in range(24)] + [("z/src/kept.js", jane(25), "code"), ("z/src/own.js", HAND, "code")]
    got = {r["file_path"]: (r["origin"], r["reason"]) for r in file_origins(files(spark, rows)).collect()}
    assert got["z/src/kept.js"] == ("vendored", "header pattern") and got["z/src/own.js"] == (None, None)
    assert {v for k, v in got.items() if "third_party" in k} == {("vendored", "path pattern")}


def test_header_signs_leave_names_open():
    assert header_signs(["Copyright (c) 2019 Jane Doe", "x", "", "generated by tool-x 1.2 from a.idl"]) == ["copyright c * jane doe", "generated by * * from *"]
