import pytest
from shop_graph import shop
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import traverse as T
from codeloom.views import clean_edges


@pytest.fixture(scope="module")
def g(spark):
    symbols, edges = shop(spark)
    edges = clean_edges(edges).cache()
    return symbols.cache(), edges, edges.where("resolved and target_symbol_id is not null").cache()


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_edges_are_one_per_statement(g):
    assert sorted(r["id"] for r in g[1].collect()) == list(range(1, 14))


def test_degrees_and_importance(g):
    symbols, _, resolved = g
    calls = {r["symbol_id"]: (r["in_count"], r["out_count"]) for r in G.degrees(resolved).where("edge_type = 'CALLS'").collect()}
    assert calls[140] == (3, 1) and calls[103] == (0, 2)
    weight = {r["id"]: r["importance"] for r in G.importance(symbols, resolved).collect()}
    assert weight[140] == pytest.approx(3**0.5, abs=1e-6) and weight[160] == 0.0


def test_dispatch_reaches_implementations_and_their_subtypes(g):
    assert ids(G.dispatch_edges(g[0], g[2]), "source_symbol_id", "target_symbol_id") == [(102, 121), (102, 131)]


def test_subtypes_have_no_depth_limit(spark):
    """A chain of 20 below a root, closed to a circle at its end."""
    edges = [(k + 1, k, "INHERITS") for k in range(20)] + [(18, 20, "INHERITS")]
    resolved = spark.createDataFrame(edges, "source_symbol_id long, target_symbol_id long, edge_type string")
    assert ids(G.subtype_closure(resolved, spark.createDataFrame([(0,)], "root long")), "root", "subtype") == [(0, k) for k in range(1, 21)]


def test_implementations_know_direct_from_indirect(g):
    assert ids(G.implementations(g[0], g[2]), "interface_id", "type_id", "direct") == [(110, 120, True), (110, 130, False)]


def test_tests_edges_validation_and_entry_points(g):
    assert ids(G.tests_edges(g[0], g[2]), "source_symbol_id", "target_symbol_id") == [(160, 102), (160, 141)]
    dropped = {r["id"]: r["dropped_by"] for r in G.validated_edges(g[0], g[1]).collect()}
    assert {r["id"]: r["dropped_by"] for r in G.validated_edges(g[0], g[1], hot=[140, 141]).collect()} == dropped
    assert dropped[10] == 1 and 9 not in dropped and 2 not in dropped
    reasons = {r["id"]: r["reason"] for r in G.entry_points(g[0], g[2]).collect()}
    assert reasons[160] == "test" and reasons[121] == "override" and reasons[141] == "exported" and 150 not in reasons


def test_dead_code_with_evidence(g):
    rows = {r["id"]: r["confidence"] for r in G.dead_code(g[0], g[1]).collect()}
    assert rows[150] == "high" and rows[102] == "medium" and not {111, 140, 141, 160} & set(rows)


def test_overloads_outline_and_search(g):
    assert [r["name"] for r in G.outline(g[0], "shop/basket.ts").collect()] == ["Basket", "addLine", "sum"]
    assert ids(G.symbol_search(g[0], g[2], text="OUCH", exclude_entry_points=True), "id") == [(170,), (171,)]


def test_callers_report_a_root_on_a_circle(g):
    seeds = g[0].where("id = 140").select(F.col("id").alias("node"))
    assert ids(T.callers(g[1], seeds), "node", "depth") == [(103, 1), (140, 1), (141, 1), (160, 2)]


def test_callees_keep_unresolved_leaves(g):
    seeds = g[0].where("id = 150").select(F.col("id").alias("node"))
    assert ids(T.callees(g[1], seeds), "callee", "depth") == [("u:", 1), ("u:smtp.push", 1)]


def test_subtypes_with_paths_and_ancestors(g):
    roots = g[0].where("id = 110").select(F.col("id").alias("root"))
    assert ids(T.subtypes(g[0], g[1], roots), "id", "depth", "path") == [(120, 1, "shop/depot.ts::Depot"), (130, 2, "shop/depot.ts::Depot>shop/kiosk.ts::Kiosk")]
    below = g[0].where("id = 130").select(F.col("id").alias("root"))
    assert ids(T.ancestors(g[0], g[1], below), "id", "depth") == [(120, 1)]


def test_shortest_path_walks_containment(g):
    hops = T.shortest_path(g[0], g[2], 101, 141).orderBy("hop").collect()
    assert [(h["from_id"], h["to_id"], h["relation"]) for h in hops] == [(101, 103, "CONTAINS"), (103, 141, "CALLS")]
    assert T.shortest_path(g[0], g[2], 101, 101).count() == 0 and T.shortest_path(g[0], g[2], 140, 160).count() == 0
    assert T.shortest_path(g[0], g[2], 140, 160, undirected=True).count() == 2


def test_impact_and_neighbourhood(spark, g):
    changed = spark.createDataFrame([("shop/voucher.ts",)], "file_path string")
    rows = {r["id"]: (r["distance"], r["risk"]) for r in T.impact(g[0], g[2], changed).collect()}
    assert rows == {170: (0, "high"), 171: (0, "high")}
    seeds = spark.createDataFrame([(141,)], "node long")
    assert ids(T.neighbourhood(g[0], g[1], seeds, depth=1), "id", "distance") == [(103, 1), (140, 1), (141, 0), (160, 1)]


def test_walks_to_the_end_have_no_bound(spark):
    import inspect

    links = spark.createDataFrame([(k, k + 1) for k in range(12)], "a long, b long")
    assert T.levels(links, spark.createDataFrame([(0,)], "node long"), None).count() == 12
    ring = spark.createDataFrame([(f"f{k}", f"f{(k + 1) % 6}", True) for k in range(6)] + [("f2", "f1", True)], "source_path string, target_path string, resolved boolean")
    assert ids(T.module_cycles(ring), "length") == [(2,), (6,)] and ids(T.module_cycles(ring, 4), "length") == [(2,)]
    assert list(inspect.signature(T.strong_components).parameters) == ["links"]


def test_components_cycles_and_communities_against_brute_force(spark):
    import random

    rng = random.Random(4)
    links = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(55)})
    reach = {k: {k} for k in range(30)}
    for _ in range(30):
        for a, b in links:
            reach[a] |= reach[b]
    true = {n: min(m for m in reach[n] if n in reach[m]) for n in range(30) if len([m for m in reach[n] if n in reach[m]]) > 1 or (n, n) in links}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in T.strong_components(df).collect()} == true
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "a long, b long")
    label = {r["node"]: r["community"] for r in T.communities(pairs).collect()}
    assert label[7] in (7, 8) and set(label) == {1, 2, 3, 7, 8}
    assert T.strong_components(df.where("false")).count() == 0


def test_empty_tables(spark, g):
    none, edges = g[0].where("false"), g[1].where("false")
    assert G.dead_code(none, edges).count() == 0 and G.validated_edges(none, edges).count() == 0
    assert T.impact(none, edges, spark.createDataFrame([], "file_path string")).count() == 0


def test_smallest_enclosing_breaks_ties_by_id(spark):
    spans = spark.createDataFrame([("f", 1, 500, 1), ("f", 100, 250, 2), ("f", 100, 250, 3), ("g", 1, 9, 4), ("f", None, 3, 5)], "file_path string, line_start int, line_end int, span_id long")
    points = spark.createDataFrame([("f", 120, 7), ("f", 400, 8), ("f", 999, 9)], "file_path string, line int, k int")
    assert ids(G.smallest_enclosing(points, spans, ["k"]), "k", "span_id") == [(7, 2), (8, 1)]


def test_call_pages_count_before_they_rank(spark):
    rows = [(1, 2, "CALLS")] * 3 + [(1, 3, "CALLS"), (1, 4, "CALLS"), (2, 4, "CALLS"), (1, 4, "USAGE"), (None, 4, "CALLS"), (1, None, "CALLS")]
    edges = spark.createDataFrame([(*r, "x") for r in rows], "source_symbol_id long, target_symbol_id long, edge_type string, total string")
    got = sorted((r["symbol_id"], r["direction"], r["neighbour"], r["calls"], r["total"]) for r in G.call_pages(edges, 2).collect())
    assert got == [(1, "callees", 2, 3, 3), (1, "callees", 3, 1, 3), (2, "callees", 4, 1, 1), (2, "callers", 1, 3, 1), (3, "callers", 1, 1, 1), (4, "callers", 1, 1, 2), (4, "callers", 2, 1, 2)]
    assert ids(G.call_pages(edges, 2, 2).where("symbol_id = 1"), "neighbour") == [(4,)]
    assert G.call_pages(edges.where("false"), 2).count() == 0


def test_chunks_find_their_symbol_by_the_first_way_that_fits(spark):
    symbols = spark.createDataFrame(
        [(1, "a.f", "f", "d/a.py", 1, 9), (2, "a.f", "f", "d/a.py", 3, 5), (3, "b.g", "g", "d/b.py", None, None), (4, "c.c", "c", "d/c.py", None, None), (5, None, None, None, None, None)],
        "id long, fqn string, name string, file_path string, line_start int, line_end int",
    )
    chunks = spark.createDataFrame(
        [(1, "a.f", "d/a.py", 7, "x"), (2, "zz", "d/a.py", 4, "x"), (3, "zz.g(int)", "d/b.py", 4, "x"), (4, None, "d/c.py", 1, "x"), (5, "zz", "d/e.py", None, "x"), (6, None, None, None, None)],
        "id long, fqn string, file_path string, line_start int, symbol_id string",
    )
    assert ids(G.chunk_symbols(chunks.drop("symbol_id"), symbols), "chunk_id", "symbol_id", "how") == [(1, 1, "fqn"), (2, 2, "span"), (3, 3, "name"), (4, 4, "stem")]
    assert ids(G.chunk_symbols(chunks, symbols), "chunk_id", "symbol_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert G.chunk_symbols(chunks.where("false"), symbols).count() == 0 and G.chunk_symbols(chunks, symbols.where("false")).count() == 0
