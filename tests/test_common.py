import pytest
from pyspark.sql import functions as F

from codeloom.operators import common
from codeloom.operators.common import keep_latest, latest_rows, lookup_join, shared_folder


def test_latest_rows_take_the_newest_and_drop_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, None, None), (None, "x", 9)], "id int, v string, updated_at int")
    assert sorted((r["id"], r["v"]) for r in latest_rows(df, "id", ["v"]).collect()) == [(1, "b"), (2, None)]
    assert latest_rows(df.where("false"), "id", ["v"]).count() == 0


def test_settled_rows_equal_latest_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2), (2, None, None), (None, "x", 9), (3, "c", 5), (4, "d", None), (4, "e", 1)], "id int, v string, updated_at int")
    want = sorted((r["id"], str(r["v"])) for r in latest_rows(df, "id", ["v"]).collect())
    assert sorted((r["id"], str(r["v"])) for r in common.settled_rows(df, "id", ["v"]).collect()) == want
    monkeypatch.setattr(common, "FEW_KEYS", 0)  # the way beyond the bound
    assert sorted((r["id"], str(r["v"])) for r in common.settled_rows(df, "id", ["v"]).collect()) == want
    assert common.settled_rows(df.where("false"), "id", ["v"]).count() == 0


def test_keep_latest_drops_results_of_old_rows(spark):
    source = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "id int, updated_at int")
    results = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 2, "new"), (2, None, "only")], "id int, updated_at int, r string")
    assert sorted(r["r"] for r in keep_latest(results, source, "id").collect()) == ["new", "only"]


def test_lookup_join_gives_the_same_with_and_without_heavy_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "r int, w string")
    for how in ("inner", "left"):
        plain = sorted(map(str, lookup_join(left, right, "k", "r", [], how).collect()))
        assert sorted(map(str, lookup_join(left, right, "k", "r", [1], how).collect())) == plain


def test_rows_without_a_key_are_not_shuffled(spark):
    left = spark.range(1000).selectExpr("case when id % 10 = 0 then id end as k", "id as v")
    right = spark.range(0, 1000, 10).selectExpr("id as r", "id + 1 as w")
    got = lookup_join(left, right, "k", "r", [], "left")
    assert got.count() == 1000 and got.where("w is not null").count() == 100 and got.where("k is null and w is null").count() == 900
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session())


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 1, 5, 6)], "id int, v string, updated_at int, _k int, _held int")
    assert latest_rows(df, "id", ["v", "_k"]).select("v", F.col("_k")).collect()[0]["_k"] == 5
