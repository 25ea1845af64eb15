"""The cascade of references keeps to what is asked: no closure of all ancestors, and the same as its SQL on crowded names."""

import random

import duckdb

from codeloom import cascade_queries, views
from codeloom.operators import cascade as R
from codeloom.operators import traverse
from codeloom.operators.common import cut

SYMBOLS = "id long, fqn string, name string, kind string, file_path string, line_start int, line_end int, column_start int, column_end int, docstring string, declared_rules string, language string, conventional_fqn string, canonical_fqn string, parent_symbol_id long, visibility string, is_test boolean, is_entry_point boolean, entry_point_reason string, importance double, updated_at timestamp"
EDGES = "id long, source_symbol_id long, target_symbol_id long, edge_type string, source_range array<int>, target_range array<int>, resolution_tier string, resolved boolean, target_raw string, properties map<string,string>, created_at timestamp"


def symbol(id, fqn, name, kind, path, conv=None, parent=None, start=None, end=None):
    return (id, fqn, name, kind, path, start, end, None, None, None, None, None, conv, None, parent, None, None, None, None, None, None)


def edge(id, source, target, kind, line=None, raw=None, resolved=True):
    return (id, source, target, kind, [line, line] if line else None, None, "index", resolved, raw, None, None)


def test_ancestors_are_not_followed_beyond_what_is_found(spark, monkeypatch):
    types, written = 40, []
    rows = [symbol(k, f"a.py::T{k}", f"T{k}", "class", "a.py") for k in range(types)] + [symbol(100 + k, f"a.py::T{k}.m{k}", f"m{k}", "method", "a.py", None, k) for k in range(types)]
    ring = [edge(10 * k + j, k, (k + j) % types, "INHERITS") for k in range(types) for j in (1, 2, 5)]  # five levels up are nearly all types
    refs = [(k, f"T{k}.m{(k + 1) % types}", "z.py", None, None, True, False) for k in range(types)] + [(99, "T0.m3", "z.py", None, None, True, False), (98, "T0.none", "z.py", None, None, True, False)]

    def counted(df):
        written.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(traverse, "cut", counted)
    monkeypatch.setattr(R, "cut", counted, raising=False)
    found = R.resolve_cascade(spark.createDataFrame(rows, SYMBOLS), spark.createDataFrame(refs, "id long, raw string, file_path string, line int, args int, receiver boolean, type_only boolean"), spark.createDataFrame(ring, EDGES))
    got = {r["id"]: (r["tier"], r["target"]) for r in found.collect()}
    assert got == {k: ("type_infer", 100 + (k + 1) % types) for k in range(types)} | {99: ("type_infer", 103), 98: ("no_match", None)}
    assert sum(written) < 4 * (len(refs) + len(ring)), written  # all pairs of types would be more


def test_crowded_names_are_resolved_as_by_the_sql(spark, tmp_path):
    for seed in (1, 2):
        pick = random.Random(seed)
        names, paths, types = ["put", "get", "run", "A", "B", *(f"r{k}" for k in range(12))], ["a.py", "b.py"], ["A", "B", "C", *"FGHIJKLMNOPQRS", None]
        rows = [symbol(k, f"{pick.choice(paths)}::T{k}", pick.choice(types), pick.choice(["class", "interface"]), pick.choice(paths), pick.choice(["p.A", "p.B", None]), None, pick.choice([1, 5, None]), pick.choice([3, 90, 250])) for k in range(30)]
        for k in range(30, 150):
            name, args = pick.choice(names), pick.choice(["", "()", "(x)", "(x,y)", "(Map<a,b>)"])
            rows.append(symbol(k, pick.choice([f"a.py::{k}.{name}{args}", f"A.{name}"]), name, "method", pick.choice([*paths, None]), pick.choice([f"p.{name}", f"p.A.{name}{args}", None]), pick.choice([*range(30), 999, None]), pick.randint(1, 220), pick.choice([pick.randint(1, 260), None])))
        rows += [symbol(200, "b.py::Solo", "Solo", "class", "b.py"), symbol(201, "b.py::lone(x)", "lone", "function", "b.py")]
        edges = [edge(k, pick.randint(0, 35), pick.randint(0, 35), pick.choice(["INHERITS", "IMPLEMENTS"]), 3) for k in range(40)]
        edges += [edge(k, pick.randint(0, 155), pick.randint(30, 149), "CALLS", pick.randint(1, 250)) for k in range(100, 400)]
        raws = ["put", "get()", "A.put", "B.run(x)", "p.A", "p.put", "p.A.get", "a.py::30.put", "A", "C", "b.py::Solo", "lone", "nothing", "A.", ".put", "x::put(y)", ""]
        edges += [edge(k, pick.randint(0, 155), None, pick.choice(["USAGE", "INHERITS"]), pick.choice([pick.randint(1, 250), None]), pick.choice(raws), False) for k in range(500, 900)]
        edges += edges[::7]
        spark.createDataFrame(rows + rows[::9], SYMBOLS).write.parquet(f"{tmp_path}/{seed}/symbols.parquet")
        spark.createDataFrame(edges, EDGES).write.parquet(f"{tmp_path}/{seed}/edges.parquet")
        con = duckdb.connect()
        for t in ("symbols", "edges"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{seed}/{t}.parquet/*.parquet'")
        want = sorted(map(str, con.execute(cascade_queries.ORACLES["s18_cascade"]).fetchall()))
        got = cascade_queries.QUERIES["s18_cascade"](spark, f"{tmp_path}/{seed}").select("id", "tier", "target", "n").collect()
        assert {r["tier"] for r in got} == set(R.STEPS) and sorted(str(tuple(r)) for r in got) == want


def test_settled_relations_equal_the_clean_ones(spark):
    edges = [edge(5, 1, 2, "CALLS"), edge(3, 1, 2, "CALLS", 7), edge(4, 1, None, "CALLS", None, "x"), edge(6, 1, None, "CALLS", None, None, None), edge(7, 1, None, "CALLS", None, ""), edge(None, 8, 9, "CALLS"), edge(8, 2, 1, "CALLS"), edge(8, 2, 1, "CALLS")]
    raw = spark.createDataFrame(edges, EDGES)
    columns = [c for c in views.EDGE_COLUMNS if c != "target_range"]
    shown = lambda df: sorted(str(r.asDict()) for r in df.collect())
    assert shown(views.settled_edges(raw, columns)) == shown(views.clean_edges(raw, columns)) and views.settled_edges(raw, columns).count() == 4
    rows = spark.createDataFrame([symbol(1, "a", "a", "class", "a.py"), symbol(1, "a", "a", "class", "a.py"), symbol(2, "b", "b", "class", "b.py")], SYMBOLS)
    assert shown(views.settled_symbols(rows)) == shown(views.clean_symbols(rows))
