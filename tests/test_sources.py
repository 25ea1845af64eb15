import pytest

from codeloom.sources import sinks
from codeloom.sources.files import discover, is_ignored, parse_ignore
from codeloom.sources.python_source import index_python, parse


def rules(*files):
    return [r for folder, text in files for r in parse_ignore(folder, text)]


def test_ignore_rules_nested_negated_and_under_ignored_folders():
    r = rules(("", "*.log\n!keep.log\n/out/\nsub/**/tmp\n# note\n\\#odd\n"), ("a", "*.txt\n!b.txt\n"), ("out", "!x.py\n"))
    hit = lambda p: is_ignored(p, r)
    assert hit("x.log") and hit("d/x.log") and not hit("keep.log") and hit("out/x.py") and not hit("d/out/x.py")
    assert hit("sub/q/tmp/f.py") and hit("a/c.txt") and not hit("a/b.txt") and not hit("c.txt") and hit("#odd")


def test_discovery_reads_a_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1\n", "b/c.md": "# t\n", "node_modules/d.js": "x", "e.log": "x", "b/e.bin": "x", ".gitignore": "*.sql\n", "f.sql": "select 1", "g.py": "y" * 50}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["file_path"]: (r["language"], r["content_type"], r["size"]) for r in discover(spark, str(tmp_path), max_bytes=40).collect()}
    assert got == {"a.py": ("python", "code", 6), "b/c.md": ("markdown", "docs", 4)}


def test_ignore_files_are_read_at_any_depth(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcdefghijklmnopqrstuv")
    deep.mkdir(parents=True)
    (deep / ".gitignore").write_text("z.py\n")
    (deep / "z.py").write_text("x = 1\n")
    (deep / "y.py").write_text("x = 1\n")
    assert [r["file_path"][-4:] for r in discover(spark, str(tmp_path)).collect()] == ["y.py"]


def test_changes_and_sessions_from_a_checkout(spark, tmp_path):
    import subprocess
    from datetime import datetime

    from codeloom.sources import git

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.test", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a b.py").write_text("1")
    (tmp_path / "c.py").write_text("1\n2\n3\n")
    run("add", "-A")
    run("commit", "-qm", "one")
    (tmp_path / "a b.py").write_text("2")
    run("commit", "-qam", "two")
    assert git.changed_paths(str(tmp_path), "HEAD~1", "HEAD") == ["a b.py"] and git.changed_paths(str(tmp_path), "HEAD") == []
    run("mv", "c.py", "d.py")
    (tmp_path / "e.py").write_text("1")
    assert git.touched_paths(str(tmp_path)) == ["d.py", "e.py"]
    rows = git.work_tree_sessions(spark, str(tmp_path), "s1", datetime(2025, 1, 1)).collect()
    assert [(r["file_path"], r["event_type"]) for r in rows] == [("d.py", "WRITE"), ("e.py", "WRITE")]
    for bad in ("no-such-ref", "--output=x"):
        with pytest.raises(ValueError):
            git.changed_paths(str(tmp_path), bad)


SOURCE = '''
import os.path as p
from .util import helper, Base

class Child(Base):
    """Doc."""
    def __init__(self):
        self.go(helper)

    @property
    def go(self, f):
        return helper(f)

async def _top():
    Child()
    p.join("a")
'''


def test_python_symbols_and_references():
    symbols, refs = parse("pkg/mod.py", SOURCE)
    assert [(s[0].split("::")[1], s[2]) for s in symbols] == [("Child", "class"), ("Child.__init__", "constructor"), ("Child.go", "method"), ("_top", "function")]
    assert ("pkg/mod.py::Child", "pkg.util.Base", "INHERITS") in [r[:3] for r in refs]
    assert ("pkg/mod.py::_top", "os.path.join", "CALLS") in [r[:3] for r in refs]
    assert parse("x.py", "def (") is None and parse("x.py", "") == ([], [])


def test_python_index_resolves_over_files(spark):
    files = spark.createDataFrame([("pkg/mod.py", SOURCE), ("pkg/util.py", "class Base:\n    pass\n\ndef helper(f):\n    return f\n"), ("bad.py", "def ("), ("n.py", None)], "file_path string, content string")
    symbols, edges = index_python(files)
    names = {r["id"]: r["fqn"] for r in symbols.collect()}
    got = {(names.get(r["source_symbol_id"], "").split("::")[-1], names.get(r["target_symbol_id"], "").split("::")[-1], r["edge_type"]) for r in edges.where("resolved").collect()}
    assert ("Child", "Base", "INHERITS") in got and ("Child.go", "helper", "CALLS") in got and ("_top", "Child", "CALLS") in got


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "/r/a", None), (1, "/q/b", "x")], "id int, file_path string, v string")
    sinks.write_relation(df, str(tmp_path / "t"), ["id"], 2)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert [r["json"] for r in sinks.as_json(df.where("id = 3")).collect()] == ['{"id":3,"file_path":"/r/a"}']
    assert [r["file_path"] for r in sinks.relative_paths(df, "/r").orderBy("id").collect()] == ["/q/b", "a"]
    from datetime import datetime

    for _ in range(2):
        sinks.append_audit(spark, str(tmp_path / "audit"), [(datetime(2025, 1, 1), "search", "q", 1, 2, 0)])
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    assert sinks.compact({"a": None, "b": [{"c": ""}], "d": 0}) == {"b": [{}], "d": 0}
    assert "codeloom_x 1" in sinks.prometheus({"x": 1}) and sinks.human({"x": 1000}) == "x  1,000"
