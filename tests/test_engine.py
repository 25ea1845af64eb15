import pytest

from codeloom.engine import Engine, Intents, route


@pytest.fixture(scope="module")
def engine(spark, sf_dir, tmp_path_factory):
    return Engine(spark, sf_dir, audit_path=str(tmp_path_factory.mktemp("audit") / "log"))


def test_routes_and_intents():
    assert route("who calls buildIndex?") == ("callers", "buildIndex") and route("what does a.b call") == ("callees", "a.b")
    assert route('"exact words"') == ("literal", "exact words") and route("where is X defined") == ("definition", "X") and route("how does it work")[0] == "search"
    assert Intents.of("buildIndex").identifier == "buildIndex" and Intents.of("the readme guide").docs and Intents.of("@Secured").literal and Intents.of("index").identifier is None


def test_search_modes(engine):
    found = engine.search("index token", limit=5)
    assert found["outcome"] in ("resolved", "no_match") and found["total"] > 0
    if found["outcome"] == "resolved":
        rows = found["results"].collect()
        assert len({r["file_path"] for r in rows}) == len(rows) <= 5
    assert engine.search("zzzqqq", allow_weak=True)["outcome"] == "no_match"
    assert engine.search("  ")["outcome"] == "invalid_argument"
    literal = engine.search("index", mode="exhaustive", content="code")
    assert literal["total"] >= literal["results"].count() > 0
    assert engine.search("[", mode="exhaustive", matching="regex")["outcome"] == "invalid_regex"
    assert engine.search("index the", mode="exhaustive", matching="all_tokens")["outcome"] == "resolved"
    assert engine.search("all classes", mode="enumerate")["total"] > 0
    assert engine.spark.read.parquet(engine.audit_path).count() >= 6


def test_symbol_verbs(engine):
    names = engine.symbols(limit=3, kinds=("function",))
    fqn = names["symbols"].first()["fqn"]
    assert engine.definition(fqn)["outcome"] == "resolved" and engine.neighbors(fqn)["outcome"] == "resolved"
    assert engine.explain(fqn)["outcome"] == "resolved" and engine.path(fqn, fqn)["outcome"] == "trivial"
    assert engine.definition("no_such_name_anywhere")["outcome"] == "not_found"
    assert engine.implementations(fqn)["outcome"] in ("resolved", "no_match")
    path = fqn.split("::")[0]
    assert engine.outline(path)["total"] > 0 and engine.impact([path])["outcome"] == "resolved" and engine.changes([path], scope="tests")["outcome"] == "resolved"


def test_reports(engine):
    assert engine.dead_code()["total"] > 0 and engine.graph_schema()["sections"].count() > 5
    out = engine.architecture(["overview", "structure", "dependencies", "hotspots", "entry_points", "clusters"])
    assert all(out[a].count() >= 0 for a in ("overview", "structure", "hotspots", "clusters")) and engine.architecture(["odd"])["outcome"] == "invalid_argument"
    assert engine.coverage(scopes=["pending"])["files"].count() >= 0 and len(engine.health()["generation"]) == 32
    assert engine.pattern("MATCH (f:Function) RETURN count(*) AS n", timeout_ms=30_000)["rows"][0]["n"] > 0
    assert engine.ask("who calls no_such_name_anywhere")["outcome"] == "not_found"
    assert engine.neighbourhood("index token")["outcome"] in ("resolved", "no_seed")


def test_related_changes_language_and_refresh(engine, tmp_path):
    row = engine.corpus.chunks_with("file_path", "line_start").orderBy("id").first()
    found = engine.related(row["file_path"], row["line_start"])
    assert found["outcome"] == "resolved" and found["related"].count() <= 5
    assert engine.related("no/such/file", 1)["outcome"] == "not_found"
    assert engine.changes()["outcome"] == "no_changes" and engine.changes(root=str(tmp_path), base="HEAD")["outcome"] == "invalid_argument"
    assert engine.refresh() == [] and engine.language("zzz qqq") is None
    assert route("what calls buildIndex") == ("callers", "buildIndex") and route("usages of a.b") == ("callers", "a.b") and route("who invokes go_on") == ("callers", "go_on") and route("buildIndex") == ("definition", "buildIndex")
