import random

import pytest

from codeloom.llm.leaks import MIN_WORDS, build_index, find_leaks, leaked_items, passages_of, words_of

rng = random.Random(11)
VOCABULARY = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]


def sentence(n, r=rng):
    return [r.choice(VOCABULARY) for _ in range(n)]


def test_words_ignore_markup_case_breaks_and_invisible_characters():
    assert words_of("> The <b>qui</b>ck,&nbsp;bro-\n> wn f\u200box’s\r\n1. **jumps** <p>over</p>") == ["the", "quick", "brown", "foxs", "jumps", "over"]
    assert words_of("") == []


def brute(passage, doc):
    """Whether some stretch of 20 words or more, whole at both ends, stands in the document with a tenth
    of it changed by substitution."""
    for i in range(len(passage)):
        for j in range(len(doc)):
            changed = 0
            for n in range(min(len(passage) - i, len(doc) - j)):
                changed += passage[i + n] != doc[j + n]
                whole = passage[i] == doc[j] and passage[i + n] == doc[j + n]
                if whole and n + 1 >= MIN_WORDS and changed * 10 <= n + 1:
                    return True
    return False


@pytest.mark.parametrize("seed", range(8))
def test_substitutions_equal_brute_force(seed):
    r = random.Random(seed)
    passage = sentence(50, r)
    index = build_index([(1, " ".join(passage))])
    for length, changes in ((20, 2), (19, 0), (24, 3), (24, 2), (40, 4), (40, 9), (50, 5)):
        at = r.randint(0, 50 - length)
        part = passage[at : at + length]
        for k in r.sample(range(1, length - 1), changes):
            part[k] = "changed"
        doc = sentence(30, r) + part + sentence(30, r)
        assert bool(find_leaks(index, " ".join(doc))) == brute(passage, doc), (length, changes)


def test_left_out_and_put_in_words_are_changes():
    passage = sentence(40)
    index = build_index([(7, " ".join(passage))])
    doc = passage[:15] + passage[16:30] + ["extra"] + passage[30:]
    assert find_leaks(index, " ".join(sentence(20) + doc))[0][:1] == (7,)
    assert find_leaks(index, " ".join(passage[:10] + sentence(30) + passage[20:33])) == []


def test_a_quotation_before_the_leak_does_not_hide_it():
    passage = sentence(60)
    index = build_index([(1, " ".join(passage))])
    leak = passage[30:52]
    leak[7] = leak[15] = "other"
    assert find_leaks(index, " ".join(passage[:19] + sentence(200) + leak))


def test_instructions_copies_nulls_and_blocks(spark, monkeypatch):
    from codeloom.llm import leaks

    ask = "Read the passage below and then answer the question that follows it in one short sentence of your own words please."
    texts = [" ".join(sentence(40)) for _ in range(6)]
    items = spark.createDataFrame([(k, f"{ask}\n\n{t}" if k % 2 else f"{t}\n{ask}", "clash") for k, t in enumerate(texts)] + [(98, None, ""), (99, "", "")], "item long, text string, document string")
    docs = spark.createDataFrame([(1, "x " + texts[2]), (2, "x " + texts[2]), (3, ask), (4, None), (5, ""), (6, texts[0] + " " + texts[1].upper()), (7, "nothing " * 5000)], "document long, text string")
    assert {r["item"] for r in passages_of(items, None).collect()} == {*range(6), 99}
    assert {r["item"]: ask not in r["text"] for r in passages_of(items).where("text <> ''").collect()} == dict.fromkeys(range(6), True)
    want = [(1, 2), (2, 2), (6, 0), (6, 1)]
    assert sorted((r["document"], r["item"]) for r in leaked_items(docs, items).collect()) == want
    monkeypatch.setattr(leaks, "FILTER_LOG2", 15)  # a filter that lets more pass finds the same
    monkeypatch.setattr(leaks, "MANY_HITS", 1)  # as does the way over every diagonal
    assert sorted((r["document"], r["item"]) for r in leaks.leaked_items(docs, items).collect()) == want
    assert leaked_items(docs.where("false"), items).count() == 0 and leaked_items(docs, items.where("false")).count() == 0


def test_short_items_and_passages_that_several_suites_hold(spark):
    shared, ask = " ".join(sentence(45)), "Name the part that the following words speak of, please."
    rows = [(k, shared) for k in range(5)] + [(5, "five plain words stand here"), (6, "four words only here"), (7, " ".join(VOCABULARY[:12])), (8, "again " * 30)]
    rows += [(k, f"{ask}\n{' '.join(sentence(30))}") for k in range(10, 15)]
    items = spark.createDataFrame(rows, "item long, text string")
    changed = VOCABULARY[:12]
    changed[6] = "other"
    docs = spark.createDataFrame([("a", shared.upper()), ("b", "so five plain words stand here"), ("c", "four words only here"), ("d", " ".join(changed)), ("e", ask), ("f", "and again " + "again " * 25)], "document string, text string")
    got = sorted((r["document"], r["item"]) for r in leaked_items(docs, items).collect())
    assert got == [*[("a", k) for k in range(5)], ("b", 5), ("d", 7), ("f", 8)]


def test_long_items_stay_within_memory():
    import tracemalloc

    r = random.Random(3)
    passage = [f"p{r.randint(0, 10**6)}" for _ in range(20_000)]
    copy = [w if r.random() > 0.05 else "changed" for w in passage]
    del copy[9_000:9_010]
    tracemalloc.start()
    got = find_leaks(build_index([(1, " ".join(passage))]), " ".join(["before"] * 500 + copy + ["after"] * 500))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and got[0][1] > 19_000 and peak < 200e6


@pytest.mark.parametrize("seed", range(6))
def test_linear_stretch_equals_all_intervals(seed):
    import numpy as np

    from codeloom.llm.leaks import _stretch

    r = random.Random(seed)
    a = np.arange(120, dtype=np.uint64)
    b = np.array([x if r.random() > 0.12 else 999 for x in range(120)], np.uint64)
    steps = [(k, k) if r.random() > 0.04 else (k, -1) for k in range(120)]
    bad = [y < 0 or a[x] != b[y] for x, y in steps]
    best = None
    for i in range(120):
        for j in range(i + 20, 121):
            edits = sum(bad[i:j])
            if not bad[i] and not bad[j - 1] and edits * 10 <= j - i:
                best = max(best or (0, 0), (j - i, -edits))
    got = _stretch(a, b, steps, 20)
    assert (got and (got[0], -got[1])) == best


def test_one_word_texts_end():
    assert best_of("nothing " * 3000, "nothing " * 2000)[1] == 2000


def best_of(text, item):
    return find_leaks(build_index([(1, item)]), text)[0]
