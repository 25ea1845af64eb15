import random

import pytest

from codeloom.operators.hierarchy import build_forest

SCHEMA = "id long, parent long, name string, ptr string"


def brute(parents):
    out = {}
    for k in parents:
        x, seen = k, []
        while parents.get(x) is not None and parents[x] in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        out[k] = (min(seen[seen.index(x) :]), -1) if x in seen else (x, len(seen))
    return out


def resolved(spark, parents):
    rows = [(k, p, f"n{k}", "extra") for k, p in parents.items()]
    forest = build_forest(spark.createDataFrame(rows, SCHEMA), "id", "parent", "name")
    lean = build_forest(spark.createDataFrame(rows, SCHEMA), "id", "parent", "name", paths=False).nodes
    assert "path" not in lean.columns
    assert {(r["id"], r["root_id"], r["depth"]) for r in lean.collect()} == {(r["id"], r["root_id"], r["depth"]) for r in forest.nodes.collect()}
    return forest, {r["id"]: (r["root_id"], r["depth"]) for r in forest.nodes.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 120
    parents = {k: rng.choice([None, rng.randrange(n + 5), max(0, k - 1), max(0, k - 1)]) for k in range(n)}
    _, got = resolved(spark, parents)
    assert got == brute(parents)


def test_chains_circles_orphans_and_stars(spark):
    parents = {0: None, **{k: k - 1 for k in range(1, 40)}, 50: 51, 51: 52, 52: 50, 53: 50, 60: 60, 70: 999, **{k: 0 for k in range(100, 140)}}
    forest, got = resolved(spark, parents)
    assert got == brute(parents)
    assert got[39] == (0, 39) and got[53] == (50, -1) and got[60] == (60, -1) and got[70] == (70, 0)
    path = {r["id"]: r["path"] for r in forest.positions().collect()}
    assert path[3] == "n0/n1/n2/n3" and path[53] is None
    circles = {(r["root_id"], r["id"]) for r in forest.circles().collect()}
    assert circles == {(50, 50), (50, 51), (50, 52), (60, 60)}
    pairs = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in forest.descendants().collect()}
    assert (0, 39, 39) in pairs and (38, 39, 1) in pairs and not any(a == d for a, d, _ in pairs)


def test_empty_null_and_repeated_rows(spark):
    empty = build_forest(spark.createDataFrame([], SCHEMA), "id", "parent", "name")
    assert empty.nodes.count() == 0
    rows = [(None, 1, "x", None), (1, None, None, None), (1, None, None, None), (2, 1, "b", None), (2, 1, "b", None)]
    forest = build_forest(spark.createDataFrame(rows, SCHEMA), "id", "parent", "name")
    assert sorted((r["id"], r["depth"], r["path"]) for r in forest.positions().collect()) == [(1, 0, "1"), (2, 1, "1/b")]
