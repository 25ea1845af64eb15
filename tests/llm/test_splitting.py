from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.splitting import split_oversized, split_points


def check(text, kind, limit, overlap):
    pieces = split_points(text, kind, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in pieces) or not text
    for (a, b), (c, d) in zip(pieces, pieces[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap
    rebuilt = text[: pieces[0][1]]
    for (_, b), (_, d) in zip(pieces, pieces[1:], strict=False):
        rebuilt += text[b:d]
    assert rebuilt == text
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r.{};é𝄞#", max_size=400), st.sampled_from(["ast", "resource", "raw_text", "infra", "?"]), st.integers(12, 60))
def test_any_text_is_covered_within_the_limits(text, kind, limit):
    check(text, kind, limit, limit // 10)


def test_least_number_of_pieces_for_even_lines():
    text = "x" * 99 + "\n"
    assert len(check(text * 20, "ast", 2000, 200)) == 1
    assert len(check(text * 21, "ast", 2000, 200)) == 2
    assert len(check(text * 400, "ast", 2000, 200)) == 1 + -(-(400 * 100 - 2000) // 1800)


def test_cuts_prefer_definitions_and_headings():
    code = "".join(f"def f{k}():\n" + "    x = 1\n" * 60 for k in range(5))
    assert all(code[b:].startswith("def ") for _, b in check(code, "ast", 2000, 200)[:-1])
    prose = "".join(f"# Part {k}\n\n" + "Some words here. \n" * 15 for k in range(20))
    assert all(prose[b:].startswith("# ") for _, b in check(prose, "raw_text", 2000, 200)[:-1])


def test_rows_lines_kinds_nulls_and_long_lines(spark):
    rows = [(1, "y" * 4001, "ast", 10), (2, ("z" * 50 + "\r\n") * 60, "ast", 5), (3, None, None, None), (4, "", "ast", 1), (5, "s" * 2000, "ast", 1), (6, "q" * 2000 + "\r\n" + "r", None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item long, content string, kind string, line_start int, piece_no string")
    got = split_oversized(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["item"], []).append(r)
    assert set(by) == {1, 2, 6}
    assert {r["cut_kind"] for r in by[1]} == {"inside_line"} and {r["cut_kind"] for r in by[2]} == {"between_lines"} == {r["cut_kind"] for r in by[6]}
    assert {(r["line_start"], r["line_end"]) for r in by[1]} == {(10, 10)}
    pieces = sorted(by[2], key=lambda r: r["piece_no"])
    assert pieces[0]["line_start"] == 5 and pieces[-1]["line_end"] == 64 and len(pieces) == pieces[0]["pieces"]
    for p in pieces:
        assert p["content"].count("\n") == p["line_end"] - p["line_start"] + 1
    assert split_oversized(df.where("false")).count() == 0
