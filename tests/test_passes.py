import math

import pytest
from pyspark.sql import functions as F
from shop_graph import shop

from codeloom.operators import passes as R
from codeloom.operators import resolve as S
from codeloom.operators import traverse as T
from codeloom.views import clean_edges

CHUNKS = "id long, fqn string, file_path string, content string, content_type string, chunk_type string, chunk_node_type string, declared_rules string, is_definition boolean, is_test boolean, subwords array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "s/till.py::Till.close_till", "s/till.py", "def close_till(): pass", "code", "ast", "method", None, True, False, ["close", "till"]),
        (2, "s/till_store.py::close_till", "s/till_store.py", "const LIMIT = 3", "code", "ast", "function", "@PostMapping", True, False, ["close", "till", "default", "limit"]),
        (3, "s/other.py::close_till", "s/other.py", "static final int DEFAULT_LIMIT = 3;", "code", "ast", "function", "@PostMapping", True, True, ["default", "limit"]),
        (4, "s/readme.md", "docs/readme.md", "the till", "docs", "raw_text", "section", None, False, False, ["till"]),
        (5, None, None, None, None, None, None, None, None, None, None), (6, "s/pom.xml", "s/pom.xml", "<x/>", "config", "resource", "block", None, False, False, []),
    ]
    return spark.createDataFrame(rows, CHUNKS).cache()


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([(1, 2.0), (4, 4.0)], "id long, score double").cache()


def scores(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_named_definitions_rise_and_come_in(pool, chunks):
    assert scores(R.stem_rescue(pool, chunks, "close_till")) == {1: 2.0, 4: 4.0}
    assert scores(R.stem_rescue(pool, chunks.withColumn("file_path", F.regexp_replace("file_path", "till_store", "close_store")), "close_till"))[2] == 4.0
    assert scores(R.definition_pass(pool, chunks, ["close_till"])) == {1: 4.0, 2: 2.0, 3: 2.0, 4: 4.0} and scores(R.definition_pass(pool, chunks, [])) == {1: 2.0, 4: 4.0}


def test_endpoints_and_constants(pool, chunks):
    got = scores(R.endpoint_pass(pool, chunks, "post endpoint that closes a till"))
    assert got[2] > got[3] > 0 and got[1] == 2.0 and scores(R.endpoint_pass(pool, chunks, "post a letter")) == {1: 2.0, 4: 4.0}
    got = scores(R.constant_pass(pool, chunks, "default limit"))
    assert got[2] == 5.6 and got[3] == 2.8 and scores(R.constant_pass(pool, chunks, "limit")) == {1: 2.0, 4: 4.0}


def test_concepts_weigh_by_rarity_and_the_leader_ends_the_pass(spark, pool, chunks):
    weights = R.concept_weights(pool, chunks, ["close", "limit"])
    assert weights == {"close": pytest.approx(math.log(1 + 2 / 2)), "limit": pytest.approx(math.log(1 + 2 / 1))}
    assert scores(R.concept_pass(pool, chunks, [])) == {1: 2.0, 4: 4.0} and scores(R.concept_pass(pool, chunks.where("false"), ["close"])) == {1: 2.0, 4: 4.0}
    many = spark.createDataFrame([(k, 1.0) for k in range(100, 200)] + [(4, 4.0)], "id long, score double")
    crowd = chunks.unionByName(spark.createDataFrame([(k, None, "x", "", "docs", "raw_text", "section", None, False, False, ["pad"]) for k in range(100, 200)], CHUNKS))
    got = scores(R.concept_pass(many, crowd, ["close"]))
    assert got[1] == 7.2 and got[2] == 2.4 and got[3] == 1.4  # the method itself, a function in no type, a test
    led = many.unionByName(spark.createDataFrame([(1, 9.0)], many.schema))
    assert scores(R.concept_pass(led, crowd, ["close"]))[1] == 9.0


def test_weights_scents_and_paths(pool, chunks):
    rows = pool.join(chunks, "id").unionByName(chunks.where("id = 6").withColumn("score", F.lit(1.0)).select("id", "score", *chunks.columns[1:]))
    # a build file is a resource and infrastructure; asked about configuration it is lifted as one and weighed down as noise
    assert scores(R.weighting(rows))[6] == 0.1225 and scores(R.weighting(rows, resource_intent=True, config_scent="config"))[6] == 0.2625
    assert scores(R.weighting(rows, code_context=True))[4] == 2.8 and scores(R.weighting(rows, exact=F.col("id") == 1))[1] == 2.5
    assert scores(R.path_boost(rows, ["tills", "zzz"]))[1] == 2.5 and scores(R.path_boost(rows, ["till"]))[1] == 2.0


def test_gates():
    assert R.quality_gate(0, 1, 1.0, 5, 0.9) == (False, 0.0) and R.quality_gate(1, 2, 1.0, 5, 0.9) == (False, 0.0) and R.quality_gate(2, 2, 0.4, 5, 0.4) == (False, 0.0)
    assert R.quality_gate(2, 2, 0.4, 5, 0.6)[0] and R.quality_gate(1, 1, 1.0, 5, 0.0)[0] and R.quality_gate(2, 3, 1.0, 0, 0.6) == (True, 0.5) and R.quality_gate(2, 3, 1.0, 0, 0.4)[0] is False
    assert R.rescue_allowed(1, 0.1) and not R.rescue_allowed(0, 0.1) and not R.rescue_allowed(2, 0.0)


def test_floors_saturation_and_suppression(spark, pool, chunks):
    assert not R.below_floor(pool) and R.below_floor(pool.where("false")) and R.below_floor(pool.withColumn("score", F.lit(0.01)))
    rows = pool.join(chunks, "id")
    assert R.saturated(rows, ["tillage"]) and not R.saturated(rows, ["zebra"]) and not R.saturated(rows, [])
    related = spark.createDataFrame([(1, "a/dto/User.java", 1.0), (2, "a/run.java", 1.0)], "id long, file_path string, score double")
    assert scores(R.suppressed(related, "code")) == {1: 0.5, 2: 1.0} and scores(R.suppressed(related, "dto")) == {1: 1.0, 2: 1.0} and scores(R.suppressed(related, "code", drop=True)) == {2: 1.0}


def test_type_sharing(spark):
    df = spark.createDataFrame([("f(A,B)", "g(A)"), ("f()", "g()"), ("f(List<A>, B)", "g(B,List)"), (None, "g(A)")], "a string, b string")
    share = R.type_sharing(R.parameter_types(F.col("a")), R.parameter_types(F.col("b")), F.col("a") == "f(List<A>, B)")
    assert [r[0] for r in df.select(share).collect()] == [0.5, 0.0, 1.0, 0.0]
    assert [r[0] for r in df.select(R.bounded(F.lit(3.0))).collect()][0] == 0.75


def test_names_resolve_by_parent_and_types(spark):
    columns = "id long, fqn string, name string, conventional_fqn string, is_test boolean, declared_rules string, parent_symbol_id long"
    rows = [
        (1, "a::Till", "Till", None, False, None, None), (2, "a::Till.close(int)", "close", None, False, None, 1), (3, "a::Till.close(Text)", "close", None, False, "@Deprecated", 1), (4, "b::Door", "Door", None, False, None, None),
        (5, "b::Door.close()", "close", None, True, None, 4), (6, "c::open", "open", "m.open", False, None, None),
    ]
    symbols = spark.createDataFrame(rows, columns)
    first = lambda target: (lambda got: (got[0], [r["id"] for r in got[1].collect()]))(S.resolve(symbols, target))
    assert first("open") == ("resolved", [6]) and first("m.open") == ("resolved", [6]) and first("Door.close") == ("resolved", [5])
    assert first("Till.close(int)") == ("resolved", [2]) and first("Till.close(Odd)")[0] == "ambiguous" and first("Till.close")[0] == "ambiguous"
    outcome, ranked = S.resolve(symbols, "close")
    assert outcome == "ambiguous" and [r["id"] for r in ranked.collect()] == [2, 5, 3] and first("zzzzzzzz") == ("not_found", [])


def test_mentions_name_what_has_a_name_of_its_own(spark):
    symbols = spark.createDataFrame([(1, "buildIndex"), (2, "run"), (3, "run"), (4, "GraphStore"), (5, None)], "id long, name string")
    docs = spark.createDataFrame([("a", "call `x.buildIndex()` and `run`"), ("b", "The GraphStore holds buildIndex twice: buildIndex"), ("c", None), ("d", "")], "document string, text string")
    assert sorted(tuple(r) for r in S.mentions(docs, symbols).collect()) == [("a", 1), ("b", 1), ("b", 4)]


def test_ego_graph_and_parents(spark):
    symbols, edges = shop(spark)
    edges = clean_edges(edges)
    around = {(r["level"], r["node_id"], r["section"], r["other_id"]) for r in T.ego_graph(symbols, edges, 102, 2).collect()}
    assert {(1, 102, "container", 101), (1, 102, "incoming", 160), (1, 102, "outgoing", 111), (2, 101, "members", 103), (2, 160, "outgoing", 141)} <= around
    assert {r["level"] for r in T.ego_graph(symbols, edges, 102, 1).collect()} == {1} and T.ego_graph(symbols, edges, -1).count() == 0
    resolved = edges.where("resolved and target_symbol_id is not null")
    reached = T.impact(symbols, resolved, spark.createDataFrame([("shop/money.ts",)], "file_path string"))
    assert {(r["id"], r["parent_id"]) for r in T.impact_parents(symbols, resolved, reached).collect()} == {(103, 140), (160, 141)}
    seeds = spark.createDataFrame([(140,)], "node long")
    assert {r["id"] for r in T.neighbourhood(symbols, edges, seeds, depth=1, fan_out=2, most=2).collect()} <= {103, 140, 141}
