from codeloom.llm.mixing import fit_membership, mix

TARGETS = "source string, weight double, max_repeats int"


def corpus(spark):
    rows = []
    for k in range(400):
        source = ("readme", "README ", "issue", "guide")[k % 4] if k < 360 else None
        text = {"r": "install the readme package and run it now ", "i": "bug crash stack error report fails ", "g": "lesson chapter learn step tutorial "}[(source or "issue").strip().lower()[0]] * (3 + k % 5)
        rows.append((k, source, text, "clash"))
    return spark.createDataFrame([*rows, (900, "issue", None, ""), (901, None, "", ""), (902, "other", "unknown words", "")], "document long, source string, text string, label string")


def test_shares_follow_weights_within_caps(spark):
    targets = spark.createDataFrame([("readme", 0.3, 1), ("issue", 0.5, 2), ("guide", 0.2, 4), ("absent", 0.1, 3), (None, 0.2, 1), ("guide2", None, 1)], TARGETS)
    made = mix(corpus(spark), targets)
    assert 0 < made.rounds < 30
    report = {r["source"]: r for r in made.report.collect()}
    assert set(report) == {"readme", "issue", "guide", "absent"} and report["absent"]["tokens"] == 0
    total = sum(r["tokens"] for r in report.values())
    everything = sum(r["available"] for r in report.values())
    assert abs(total - everything) < 0.03 * everything
    # a third each more than wanted: what the absent source can't give is spread evenly
    spread = [report[s]["share"] - report[s]["weight"] for s in ("readme", "issue", "guide")]
    assert max(spread) - min(spread) < 0.03
    copies = {r["document"]: r["copies"] for r in made.documents.collect()}
    assert max(copies.values()) <= 4 and 902 not in copies or copies.get(902, 0) <= 4


def test_caps_bind(spark):
    targets = spark.createDataFrame([("readme", 0.1, 1), ("guide", 0.9, 1)], TARGETS)
    made = mix(corpus(spark), targets)
    rows = {r["source"]: r for r in made.report.collect()}
    assert rows["guide"]["tokens"] <= rows["guide"]["available"] and rows["readme"]["tokens"] <= rows["readme"]["available"]


def test_unlabelled_documents_get_posteriors():
    model = fit_membership(["a", "b", "c"], [("a", "red box"), ("a", "red map"), ("b", "deep ontology")])
    p = model.posterior("red words")
    assert p[0] > 0.6 and p[2] < 1e-6 and abs(sum(p) - 1) < 1e-9


def test_empty_tables(spark):
    targets = spark.createDataFrame([("readme", 1.0, 1)], TARGETS)
    assert mix(corpus(spark).where("false"), targets).documents.count() == 0
    assert mix(corpus(spark), targets.where("false")).documents.count() == 0


def test_capped_sources_do_not_keep_the_fit_going(spark):
    """All sources but one are at their caps, and all are: both settle."""
    for weights in ((0.9, 0.1), (0.5, 0.5)):
        targets = spark.createDataFrame([("readme", weights[0], 1), ("guide", weights[1], 1)], TARGETS)
        assert mix(corpus(spark), targets).rounds < 100
