import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from shop_graph import shop

from codeloom.plans.pattern import execute as run
from codeloom.plans.pattern.builder import build
from codeloom.plans.pattern.errors import PatternError
from codeloom.plans.pattern.graph_views import PatternGraph
from codeloom.plans.pattern.syntax import parse, tokenize
from codeloom.views import clean_edges


@pytest.fixture(scope="module")
def graph(spark):
    symbols, edges = shop(spark)
    links = [("shop/basket.ts", "shop/money.ts", "", True), ("shop/basket.ts", None, "left-pad", False), ("shop/kiosk.ts", "shop/depot.ts", "", True)]
    return PatternGraph(symbols.cache(), clean_edges(edges).cache(), spark.createDataFrame(links, "source_path string, target_path string, target_raw string, resolved boolean"))


def answer(graph, text):
    return [tuple(r) for r in build(text, graph).collect()]


def answers(graph, text):
    return sorted(answer(graph, text), key=repr)


# scanning and parsing


def test_words_quotes_and_remarks():
    read = lambda text: [t.value for t in tokenize(text)]
    assert "two words" in read("RETURN s.`two words`") and "tab\there" in read(r"RETURN 'tab\there'")
    assert not {"hidden", "gone"} & set(read("MATCH (s) // hidden\n/* gone */ RETURN s.id"))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("MATCH (s RETURN s", "syntax"), ("RETURN", "syntax"), ("DELETE s", "unsupported"), ("MATCH (s) SET s.name = 'x' RETURN s", "unsupported"), ("MATCH (s)-[:CALLS*0..3]->(t) RETURN s.id", None),
     ("MATCH (s)-[:CALLS*2..99]->(t) RETURN s.id", None)],
)
def test_what_cannot_be_parsed(text, kind):
    with pytest.raises(PatternError) as caught:
        parse(text)
    assert kind is None or caught.value.kind == kind


@pytest.mark.parametrize(
    "text",
    ["MATCH (s:Planet) RETURN s.id", "MATCH (s) RETURN other.id", "MATCH (s) RETURN s.colour", "MATCH (s)-[:ADMIRES]->(t) RETURN s.id", "MATCH (s) WHERE max(s.id) > 3 RETURN s.id",
     "MATCH (s) RETURN s.id AS a UNION MATCH (s) RETURN s.id AS a, s.name AS b"],
)
def test_what_has_no_meaning(graph, text):
    with pytest.raises(PatternError):
        build(text, graph)


# matching


def test_nodes_by_label_property_and_text(graph):
    assert answers(graph, "MATCH (c:Class) WHERE c.name CONTAINS 'ouch' RETURN c.name") == [("GiftVoucher",), ("Voucher",)]
    assert answers(graph, "MATCH (f:Function {file_path: 'shop/money.ts'}) RETURN f.name") == [("centsOf",), ("taxOn",)]
    assert answers(graph, "MATCH (m:Method) WHERE m.name =~ 't.ke' AND m.line_start < 3 RETURN m.file_path") == [("shop/kiosk.ts",), ("shop/shelf.ts",)]
    assert answers(graph, "MATCH (f:Function) WHERE f.name ENDS WITH 'y' OR f.name STARTS WITH 'tax' RETURN f.name") == [("notify",), ("retry",), ("taxOn",)]
    assert answers(graph, "MATCH (s) WHERE s.name IN ['Depot', 'sum', 'none'] RETURN s.id") == [(103,), (120,)] and answer(graph, "MATCH (s) WHERE s.name IN [] RETURN s.id") == []


def test_hops_in_every_direction(graph):
    assert answers(graph, "MATCH (m:Method)-[:CALLS]->(f:Function) RETURN m.name, f.name") == [("sum", "centsOf"), ("sum", "taxOn")]
    assert answers(graph, "MATCH (f:Function {name: 'taxOn'})<-[:CALLS]-(s) RETURN s.name") == [("checkBasket",), ("sum",)]
    assert answers(graph, "MATCH (f:Function {name: 'taxOn'})-[:CALLS]-(s) RETURN s.name") == [("centsOf",), ("checkBasket",), ("sum",)]
    assert answers(graph, "MATCH (k)-[:INHERITS]->(d)-[:IMPLEMENTS]->(i:Interface) RETURN k.name, d.name, i.name") == [("Kiosk", "Depot", "Shelf")]
    assert answers(graph, "MATCH (f:Function)-[:CALLS]->(f) RETURN f.name") == [("centsOf",), ("retry",)]


def test_walks_of_several_steps(graph):
    assert answers(graph, "MATCH (t:Function {name: 'checkBasket'})-[:CALLS*1..2]->(s) RETURN s.name") == [("addLine",), ("centsOf",), ("take",), ("taxOn",)]
    assert answers(graph, "MATCH (s)-[:INHERITS*1..3]->(d:Class {name: 'Depot'}) RETURN s.name") == [("Kiosk",)]


def test_members_files_and_what_stays_unresolved(graph):
    assert answers(graph, "MATCH (o)-[:CONTAINS]->(m:Method {name: 'take'}) RETURN o.name") == [("Depot",), ("Kiosk",), ("Shelf",)]
    assert answers(graph, "MATCH (a:File)-[:IMPORTS]->(b:File) RETURN a.name, b.name") == [("basket.ts", "money.ts"), ("kiosk.ts", "depot.ts")]
    assert answers(graph, "MATCH (s)-[c:CALLS]->(u:Unresolved) RETURN s.name, u.name, c.resolved") == [("notify", "smtp.push", 0)]


def test_patterns_side_by_side_and_optional_ones(graph):
    assert answers(graph, "MATCH (b:Class {name: 'Basket'})-[:CONTAINS]->(m), (m)-[:CALLS]->(t) RETURN m.name, t.name") == [("addLine", "take"), ("sum", "centsOf"), ("sum", "taxOn")]
    assert answers(graph, "MATCH (b)-[:CONTAINS]->(m)-[:CALLS]->(t), (u)-[:CALLS]->(m) RETURN b.name, t.name, u.name") == [("Basket", "take", "checkBasket")]
    assert answers(graph, "MATCH (c:Class) OPTIONAL MATCH (c)-[:INHERITS]->(b) RETURN c.name, b.name") == [("Basket", None), ("Depot", None), ("GiftVoucher", "Voucher"), ("Kiosk", "Depot"), ("Voucher", None)]


def test_a_path_starts_at_its_bound_node(graph):
    text = "MATCH (m:Method {name: 'addLine'}) MATCH (u)-[:CALLS]->(m)-[:CALLS]->(t) RETURN u.name, m.name, t.name"
    assert answers(graph, text) == [("checkBasket", "addLine", "take")]
    plan = build(text, graph)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan


@pytest.mark.parametrize(
    "text",
    ["MATCH (s)-[c:CALLS]->(t) RETURN s.name, c.line, t.name", "MATCH (t:Function)<-[:CALLS]-(s)-[:CALLS]->(u) RETURN t.name, s.name, u.name", "MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(g:Function) RETURN f.name, g.name",
     "MATCH (f:Function) WHERE NOT EXISTS { (f)-[:CALLS]->(:Function) } RETURN f.name"],
)
def test_hot_targets_are_met_where_the_edges_lie(graph, text):
    hot = PatternGraph(graph.symbols, graph.edges, graph.modules, hot=[140, 102])
    assert answers(hot, text) == answers(graph, text)


def test_exists_as_filter_and_value(graph):
    assert answers(graph, "MATCH (f:Function) WHERE NOT EXISTS { (s)-[:CALLS]->(f) } RETURN f.name") == [("checkBasket",), ("notify",)]
    assert answers(graph, "MATCH (f:Function) WHERE EXISTS { (f)<-[:CALLS]-(s) WHERE s.is_test = 1 } RETURN f.name") == [("taxOn",)]
    assert answers(graph, "MATCH (c:Class) RETURN c.name, EXISTS { (c)-[:CONTAINS]->() } AS full") == [("Basket", 1), ("Depot", 1), ("GiftVoucher", 0), ("Kiosk", 1), ("Voucher", 0)]


# values and shapes of results


def test_grouping_ordering_and_paging(graph):
    assert answer(graph, "MATCH (m:Method) RETURN m.name AS name, count(*) AS n ORDER BY n DESC, name") == [("take", 3), ("addLine", 1), ("sum", 1)]
    assert answer(graph, "MATCH (f:Function) RETURN min(f.id), max(f.line_end), sum(f.importance), collect(f.name)") == [(140, 15, 4.0, ["centsOf", "checkBasket", "notify", "retry", "taxOn"])]
    assert answer(graph, "MATCH (c:Class) RETURN c.name AS n ORDER BY n DESC SKIP 1 LIMIT 2") == [("Kiosk",), ("GiftVoucher",)]
    assert answer(graph, "MATCH (m:Method) RETURN DISTINCT m.name AS n ORDER BY n LIMIT 2") == [("addLine",), ("sum",)]
    assert answer(graph, "MATCH (m:Method) WITH m.name AS n, count(*) AS k WHERE k > 1 RETURN n, k") == [("take", 3)]
    assert answer(graph, "MATCH (c:Interface) RETURN c.name AS n UNION MATCH (c:Class) WHERE c.id > 160 RETURN c.name AS n ORDER BY n") == [("GiftVoucher",), ("Shelf",), ("Voucher",)]


def test_functions_and_arithmetic(graph):
    one = "MATCH (f:Function {name: 'taxOn'}) RETURN "
    assert answer(graph, one + "toUpper(f.name), substring(f.name, 3, 2), replace(f.name, 'On', 'Off'), trim('  a '), size(f.name)") == [("TAXON", "On", "taxOff", "a", 5)]
    assert answer(graph, one + "9 / 2, 9 % 4, -f.line_start, id(f), coalesce(f.canonical_fqn, f.name)") == [(4, 1, -7, 141, "taxOn")]
    assert answer(graph, one + "CASE WHEN f.importance > 3 THEN 'heavy' ELSE 'light' END, labels(f)") == [("heavy", "Function")]
    assert answer(graph, "UNWIND [2, 3] AS x UNWIND ['a', 'b'] AS y RETURN x * x AS q, y ORDER BY q, y") == [(4, "a"), (4, "b"), (9, "a"), (9, "b")]


def test_names_that_clash_and_whole_nodes(graph):
    both = build("MATCH (i:Interface) RETURN i AS x, i.id AS x", graph)
    assert both.columns == ["x", "x_2"] and '"name":"Shelf"' in both.first()["x"]


# pages and outcomes


def test_a_page_leads_to_the_next(graph):
    text = "MATCH (m:Method) RETURN m.id AS id ORDER BY id"
    seen, cursor = [], None
    while True:
        page = run.execute(text, graph, limit=2, cursor=cursor, timeout_ms=30_000, generation="g1")
        seen += [r["id"] for r in page["rows"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert seen == [102, 103, 111, 121, 131]
    first = run.execute(text, graph, limit=2, timeout_ms=30_000, generation="g1")["next_cursor"]
    stale = [run.execute(text, graph, cursor=first, generation="g2"), run.execute("MATCH (s) RETURN s.id", graph, cursor=first, generation="g1")]
    assert {p["error_kind"] for p in stale} == {"stale_cursor"} and run.execute(text, graph, cursor="?")["error_kind"] == "invalid_cursor"


def test_text_in_quotes_is_only_text(graph):
    for words in ("nobody' OR '1' = '1", "%", "x`; SHOW TABLES"):
        quoted = words.replace("'", "\\'")
        assert run.execute(f"MATCH (s) WHERE s.name = '{quoted}' RETURN s.id", graph, timeout_ms=30_000)["outcome"] == "no_match"


def test_failures_of_the_engine_are_not_the_callers(graph, monkeypatch):
    def broken(text, graph):
        raise RuntimeError("lost an executor")

    monkeypatch.setattr(run, "build", broken)
    got = run.execute("MATCH (s) RETURN s.id", graph)
    assert (got["outcome"], got["error_kind"]) == ("failed", "execution")


_PIECES = ["MATCH", "WHERE", "RETURN", "WITH", "(s)", "(s:Class)", "-[:CALLS]->", "<-[c]-", "s.name", "s.id", "=", "'x'", "1", "AND", "NOT", "EXISTS", "{", "}", "[", "]", ",", "AS", "n", "count(*)", "ORDER BY", "*", "|", "`", "\\"]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(_PIECES), max_size=12).map(" ".join))
def test_any_pieces_are_planned_or_refused(graph, text):
    """Whatever is written, planning ends in a plan or in a stated error."""
    try:
        build(text, graph)
    except PatternError as error:
        assert error.kind
