from codeloom.llm.levels import BANDS, agreed_ratings, english_body, fit_models, prose_sentences, reading_levels

EASY = "The cat has a red box. It puts the box in the big tree. You see the dog and the map. "
HARD = "In accordance with the probabilistic regularization, the epistemological ontology of semantic dimensionality constitutes the heterogeneous parameterization. "


def test_sentences_leave_out_what_is_not_prose():
    text = "# Title\n\nThe first line goes\non here. The second one ends.\n\n- a list item of words\n\n```js\nvar x = 1;\n```\n\n10:21 [INFO] index=34\n\nSee https://a.example/b .\n\n<p>The last one is here.</p>"
    assert [" ".join(s) for s in prose_sentences(text)] == ["the first line goes on here", "the second one ends", "a list item of words", "the last one is here"]
    assert prose_sentences("") == [] and english_body(None) == [] and english_body("tbd") == []


def test_other_languages_have_no_body():
    assert english_body("Der Filter liest die Tabelle für jede Datei. Ein Pfad zählt das Ergebnis.") == []
    assert english_body("Le module lit la table. " + EASY * 3)


def test_ratings_need_a_majority(spark):
    df = spark.createDataFrame([(1, "entry", "a"), (1, "entry", "b"), (1, "expert", "c"), (2, "entry", "a"), (2, "expert", "b"), (3, None, "a"), (4, "odd", "a"), (5, "entry", "a"), (5, "entry", "a")], "document long, band string, rater string")
    assert {r["document"]: r["band"] for r in agreed_ratings(df).collect()} == {1: "entry", 5: "entry"}


def test_held_out_documents_get_their_level():
    models = fit_models([("entry", english_body(EASY * 5)), ("expert", english_body(HARD * 5))])
    scores = models.scores([["the", "red", "map"], ["the", "semantic", "ontology"], ["unheard", "of", "words"]])
    assert [BANDS[k] for k in scores[:2].argmax(1)] == ["entry", "expert"]


def test_rows_majority_nulls_copies_and_empty_tables(spark):
    docs = [(1, EASY * 4), (2, HARD * 4), (3, EASY * 4 + HARD), (4, None), (5, ""), (6, "n/a"), (7, "20:20 [INFO] a=1\n" * 50), (8, EASY * 4), (9, HARD * 2000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "document long, text string, band string")
    labels = spark.createDataFrame([(1, "entry", "a"), (2, "expert", "a"), (4, "entry", "a")], "document long, band string, rater string")
    got = {r["document"]: r["band"] for r in reading_levels(df, labels).collect()}
    assert got == {1: "entry", 2: "expert", 3: "entry", 8: "entry", 9: "expert"}
    assert reading_levels(df.where("false"), labels).count() == 0 and reading_levels(df, labels.where("false")).count() == 0
