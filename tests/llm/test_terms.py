import math
from collections import Counter

import pytest

from codeloom.llm.terms import distinctive_terms, reconcile, term_frequencies

SCHEMA = "record long, language string, terms array<string>, term string, n int"
ROWS = [
    (1, "go", ["A", " a ", "b", None, "", "é"], "clash", 1), (2, "go", ["b", "b", "b"], "clash", 1), (3, "go", None, None, None), (4, "go", [], None, None), (5, "py", ["a"] * 4 + ["c"], "x", 2),
    (6, "py", ["Z" * 9000, "c"], "x", 2), (7, "py", ["c"], "x", 2),
]


def clean(terms):
    return [t.strip().lower() for t in terms or [] if t and t.strip()]


def test_frequencies_equal_brute_force(spark):
    got = {(r["term"], r["language"]): (r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    size = Counter(r[1] for r in ROWS)
    occ, rec = Counter(), Counter()
    for _, language, terms, _, _ in ROWS:
        for t in clean(terms):
            occ[t, language] += 1
        for t in set(clean(terms)):
            rec[t, language] += 1
    want = {k: (occ[k], rec[k], "rare" if rec[k] <= 2 else "common" if rec[k] >= 0.2 * size[k[1]] else None) for k in occ}
    assert got == want


def test_many_records_of_one_hot_term_and_batches(spark):
    rows = [(k, "py", ["hot"] * 2 + [f"t{k % 7}"], None, None) for k in range(500)]
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in term_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got["hot"] == (1000, 500, "common") and got["t0"][1] == 72 and got["t0"][2] is None


def test_scores_are_adjusted_residuals(spark):
    got = {(r["record"], r["term"]): r for r in distinctive_terms(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    cells = {(r[0], t): c for r in ROWS for t, c in Counter(clean(r[2])).items()}
    row, col = Counter(), Counter()
    for (k, t), c in cells.items():
        row[k] += c
        col[t] += c
    total = sum(cells.values())
    assert set(got) == set(cells)
    for (k, t), c in cells.items():
        e = row[k] * col[t] / total
        v = e * (1 - row[k] / total) * (1 - col[t] / total)
        assert got[k, t]["score"] == pytest.approx((c - e) / math.sqrt(v)) and got[k, t]["n"] == c
        assert got[k, t]["doc_count"] == sum(1 for x in cells if x[1] == t)


def test_least_count_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r["record"], r["term"]) for r in distinctive_terms(df, 3).collect()} == {(2, "b"), (5, "a")}
    assert distinctive_terms(df.where("false")).count() == 0 and term_frequencies(df.where("false")).count() == 0
    alone = distinctive_terms(spark.createDataFrame([(1, "go", ["x"], None, None)], SCHEMA)).collect()
    assert alone[0]["score"] is None


def test_stated_counts_merge_spellings_and_shards(spark):
    counted = term_frequencies(spark.createDataFrame([(1, "python", ["a", "b"], None, None), (2, "unknown", ["a"], None, None)], SCHEMA))
    stats = spark.createDataFrame(
        [("a", "python", 1, 0), ("a", "python", 1, 0), (" A", "py", 4, 1), ("b", "python", None, 0), ("b", "python", 9, 1), ("a", None, 2, 0), ("only", "go", 3, 0), (None, "go", 1, 0)],
        "token string, language string, doc_count long, shard int",
    )
    got = {(r["term"], r["language"]): (r["records"], r["stated_records"]) for r in reconcile(counted, stats).collect()}
    assert got == {("a", "python"): (1, 5), ("b", "python"): (1, 1), ("a", "unknown"): (1, 2), ("only", "go"): (0, 3)}
