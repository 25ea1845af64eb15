from pyspark.sql import functions as F
from shop_graph import shop

from codeloom.operators import cascade as R
from codeloom.views import clean_edges

SYMBOLS = "id long, fqn string, name string, kind string, file_path string, conventional_fqn string, parent_symbol_id long, line_start int, line_end int"
REFS = "id long, raw string, file_path string, line int, args int, receiver boolean, type_only boolean"
EDGES = "source_symbol_id long, target_symbol_id long, edge_type string"


def test_every_step_decides_in_its_turn(spark):
    symbols = spark.createDataFrame(
        [
            (1, "a.py::Store", "Store", "class", "a.py", "a.Store", None, 1, 30), (2, "a.py::Store.put(x)", "put", "method", "a.py", "a.Store.put(x)", 1, 2, 5), (3, "a.py::Store.put(x,y)", "put", "method", "a.py", "a.Store.put(x,y)", 1, 6, 9),
            (4, "b.py::Cache", "Cache", "class", "b.py", "b.Cache", None, 1, 20), (5, "b.py::Cache.get(k)", "get", "method", "b.py", None, 4, 2, 4), (6, "c.py::lone", "lone", "function", "c.py", None, None, 1, 3),
            (7, "d.py::twin", "twin", "function", "d.py", None, None, 1, 9), (8, "e.py::twin", "twin", "function", "e.py", None, None, 50, 60), (9, "f.py::Shape", "Shape", "class", "f.py", None, None, 1, 2), (10, "g.py::Shape", "Shape", "function", "g.py", None, None, 1, 2),
        ],
        SYMBOLS,
    )
    edges = spark.createDataFrame([(4, 1, "INHERITS")], EDGES)
    refs = [
        (1, "a.py::Store", "z.py", None, None, False, False), (2, "b.Cache", "z.py", None, None, False, False), (3, "Store.put", "z.py", None, 2, True, False), (4, "Store.put", "z.py", None, None, True, False), (5, "Cache.put", "z.py", None, 1, True, False),
        (6, "twin", "d.py", None, None, False, False), (7, "twin", "z.py", 55, None, False, False), (8, "twin", "z.py", 99, None, False, False), (9, "lone", "z.py", None, None, False, False), (10, "Other.lone", "z.py", None, None, True, False),
        (11, "Shape", "z.py", None, None, False, True), (12, "nothing", "z.py", 1, 1, False, False), (13, None, "z.py", None, None, None, None), (14, "Cache.get", "z.py", None, 7, True, False),
    ]
    got = {r["id"]: (r["tier"], r["target"]) for r in R.resolve_cascade(symbols, spark.createDataFrame(refs, REFS), edges).collect()}
    assert got == {
        1: ("exact", 1), 2: ("conventional", 4), 3: ("conventional", 3), 4: ("ambiguous", None), 5: ("type_infer", 2), 6: ("same_file", 7), 7: ("range", 8), 8: ("ambiguous", None), 9: ("fallback", 6),
        10: ("ambiguous", None), 11: ("fallback", 9), 12: ("no_match", None), 13: ("no_match", None), 14: ("conventional", 5),
    }
    none = spark.createDataFrame([], REFS)
    assert R.resolve_cascade(symbols, none, edges).count() == 0 and R.resolve_cascade(symbols.where("false"), spark.createDataFrame(refs, REFS), edges.where("false")).where("target is not null").count() == 0


def test_imports_lead_within_their_repository(spark):
    symbols = spark.createDataFrame([("Ring", "class", "r/src/shapes.py", "src.shapes.Ring"), ("Ring", "class", "q/x.py", None)], "name string, kind string, file_path string, conventional_fqn string")
    files = spark.createDataFrame([(p,) for p in ("r/src/shapes.py", "r/src/util/__init__.py", "r/web/app/main.ts", "r/web/lib/index.ts", "r/web/app/view.tsx", "r/src/core/api.ts", "q/x.py", None)], "file_path string")
    rows = [
        (1, "r/src/a.py", "src.shapes.Ring"), (2, "r/src/a.py", "util"), (3, "r/src/a.py", "util.trim"), (4, "r/src/a.py", "other.Ring"), (5, "q/y.py", "shapes"), (6, "r/web/app/main.ts", "./view"), (7, "r/web/app/main.ts", "../lib"),
        (8, "r/web/app/main.ts", "@app/core/api"), (9, "r/web/app/main.ts", "react"), (10, None, "x"), (11, "r/src/a.py", None),
    ]
    found = R.resolve_imports(spark.createDataFrame(rows, "id long, source_path string, raw string"), symbols, files, [("@app/*", "src/*")])
    got = {r["id"]: (r["target_path"], r["how"]) for r in found.collect()}
    assert got == {
        1: ("r/src/shapes.py", "conventional"), 2: ("r/src/util/__init__.py", "module"), 3: ("r/src/util/__init__.py", "module"), 4: ("r/src/shapes.py", "type"), 5: (None, "external"), 6: ("r/web/app/view.tsx", "path"), 7: ("r/web/lib/index.ts", "path"),
        8: ("r/src/core/api.ts", "path"), 9: (None, "external"), 10: (None, "external"), 11: (None, "external"),
    }


def test_edges_are_refined_by_what_they_join(spark):
    symbols, edges = shop(spark)
    rows = edges.select("id", "source_symbol_id", "target_symbol_id", F.when(F.col("id") == 6, "INHERITS").when(F.col("id") == 7, "CALL_REFERENCE").otherwise(F.col("edge_type")).alias("edge_type"), "source_range", "resolution_tier", "resolved", F.create_map(F.lit("via"), F.when(F.col("id") == 2, "import").otherwise("index")).alias("properties"))
    got = {r["id"]: (r["edge_type"], r["resolution_tier"]) for r in R.refined_edges(rows, symbols).collect()}
    assert got[6] == ("IMPLEMENTS", "exact") and got[7] == ("USAGE", "exact") and got[2] == ("CALLS", "import") and got[9] == ("CALLS", "exact") and 10 not in got and 11 not in got


def test_members_below_a_type(spark):
    symbols, edges = shop(spark)
    resolved = clean_edges(edges).where("resolved and target_symbol_id is not null")
    ask = spark.createDataFrame([(111,)], "id long")
    got = {(r["type_id"], r["implementation_id"], r["how"]) for r in R.member_implementations(symbols, resolved, ask).collect()}
    assert got == {(120, 121, "declared"), (130, 131, "declared")}
    lacking = symbols.where("id <> 131")
    assert {(r["type_id"], r["implementation_id"], r["how"]) for r in R.member_implementations(lacking, resolved, ask).collect()} == {(120, 121, "declared"), (130, 121, "inherited")}
    assert R.member_implementations(symbols, resolved.where("false"), ask).count() == 0
