"""Literal cases of text, Markdown and signal functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions import signals as S
from lectern.functions import text as X
from lectern.operators import assets as A
from lectern.operators import compete as C
from lectern.operators import layout as L
from lectern.operators import tables as B


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.clean_text, " a \n b\x07 ", "a b"),
        (X.clean_text, None, ""),
        (X.word_count, "a b  c\n", 3),
        (X.word_count, "", 0),
        (X.normalize_url, "x.org/p?q=1#f", "https://x.org/p?q=1"),
        (X.validate_url, "nowhere", "Invalid URL format"),
        (X.validate_url, "https://u@x.org:80/p", None),
        (X.domain, "https://u@X.org:80/p", "u@X.org:80"),
        (X.is_valid_url, None, False),
        (X.title_like, "The Great Escape", True),
        (X.title_like, "", False),
        (X.parse_pixels, " 12px", 12),
        (X.parse_pixels, "wide", None),
        (M.to_text, "# T\n**b** [l](u) ![i](p)\n- x", "T\nb l \nx"),
        (M.tidy_quotes, ">q", "\n> q\n"),
        (M.typography, "a--b  c .Then $x  y$", "a—b c. Then $x  y$"),
        (M.clean_up, "a  \n\n\n\n<div class='x'>b</div>", "a\n\nb"),
        (M.tidy_images, "![](a/my-pic_1.png)", "\n![My Pic 1](a/my-pic_1.png)\n"),
        (M.tag_code, "```\nimport os\n```", "\n```python\nimport os\n```\n"),
        (M.break_paragraphs, "a\nb\n- c\n- d\n```x\ne\n```", "a\n\nb\n\n- c\n- d\n\n```x\ne\n```"),
        (M.format_markdown, "a\n```python\nx  =  1 .A\n```\nb  c", "a\n\n```python\nx  =  1 .A\n```\n\nb c"),
        (M.format_markdown, None, ""),
        (S.is_caption, " Fig. 3 shows\nmore", True),
        (S.is_caption, "Figures", False),
        (S.algorithm_score, "", 0),
        (S.is_algorithm, "Algorithm 1 Sort\nRequire: a list\n1: for each x do\n2: return x\n3: end for", True),
        (S.is_algorithm, "We return to the matter if it rains.", False),
        (S.has_markdown, "plain words", False),
        (B.is_row, "a\tb\tc", True),
        (B.is_row, "name   size   price", True),
        (B.is_row, "and the   of a   is it", False),
    ],
)
def test_strings(spark, function, given, wanted):
    assert value(spark, function(F.col("x").cast("string")), x=given) == wanted


def test_compat_of_lists(spark):
    text = "**b** x\n-5\n* a\n2) c"
    assert value(spark, M.tidy_lists(F.col("x"), compat=False), x=text) == "**b** x\n-5\n- a\n2. c"
    assert value(spark, M.tidy_lists(F.col("x")), x=text).startswith("- *b** x")


def test_urls_resolve(spark):
    base = F.lit("https://x.org/dir/page")
    for href, wanted in (("/page1", "https://x.org/page1"), ("../page", "https://x.org/page"), ("https://y.org/z", "https://y.org/z"), ("q", "https://x.org/dir/q"), ("", "https://x.org/dir/page")):
        assert value(spark, X.absolute_url(F.col("h"), base), h=href) == wanted


@pytest.mark.parametrize(("figure", "wanted"), [((0, 0, 100, 100), True), ((200, 200, 300, 300), False), ((10, 0, 35, 50), False), ((10, 0, 40, 50), True)])
def test_containment(spark, figure, wanted):
    text, fig = L.box(*map(F.lit, (10, 10, 60, 20))), L.box(*map(F.lit, figure))
    assert value(spark, L.inside(text, fig), x=1) == wanted


def test_gate(spark):
    rows = lambda *r: F.array(*[F.array(*map(F.lit, x)) for x in r])
    cases = {
        "pass": rows(("Name", "Age", "City"), ("Ann", "31", "Rome"), ("Bob", "42", "Oslo")),
        "too_few_rows": rows(("a", "b")),
        "too_few_cols": rows(("a",), ("b",)),
        "low_occupancy": rows(("a", "", ""), ("", "b", ""), ("", "", "")),
        "low_uniqueness": rows(("a", "b"), ("a", "b")),
        "prose_like_cells": rows(("Scaffoldi", "ng is", "fun"), ("wor", "ds go", "on"), ("Here", "too", "x")),
    }
    for reason, data in cases.items():
        assert value(spark, B.quality(data), x=1)["reason"] == reason


def test_budget(spark):
    kept = A.within_budget(F.array(*map(F.lit, (3, 9, 4, 2))), lambda s: s, 100, 9)
    assert value(spark, kept, x=1) == [3, 4, 2]


def test_merges(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n"
    other = "| c | d |\n|---|---|\n| 3 | 4 |\n"
    out = value(spark, C.merge_tables(F.col("p"), F.col("s")), p=table, s=table + "\n" + other)
    assert out.count("| a | b |") == 1 and "| c | d |" in out
    assert value(spark, C.merge_formulas(F.col("p"), F.col("s")), p="x", s="$$a$$ $$b$$").count("$$") == 4
    assert value(spark, C.merge_code(F.col("p"), F.col("s")), p="```py\nx\n```", s="```py\nx\n```") == "```py\nx\n```"


def test_synthesis_ignores_failures(spark):
    rows = [(1, "docling", 1, True, "words"), (1, "marker", 2, True, "| a |\n| b |\n| c |"), (1, "mineru", 3, False, "# x\n" * 50)]
    got = C.synthesize(spark.createDataFrame(rows, "doc_id int, engine string, rank int, success boolean, content string")).first()
    assert (got.engine, got.other, got.supplements) == ("marker", "docling", [])


def test_script_types(spark):
    for size, y, wanted in ((10, 100, "normal"), (5, 90, "superscript"), (5, 110, "subscript"), (6, 100, "superscript"), (7, 100, "normal")):
        assert value(spark, L.script_type(F.lit(size), F.lit(y), F.lit(100), F.lit(10)), x=1) == wanted


def test_passes_over_lines_are_linear(spark):
    """100,000 lines: a blank line between plain ones, runs of rows in order, sums of all before."""
    import time

    from lectern.functions import markdown as M
    from lectern.functions import text as X
    from lectern.operators import tables as B

    n = 100_000
    text = "\n".join("- item" if i % 10 < 3 else "```" if i % 10 in (4, 7) else f"line {i}" for i in range(n))
    rows = "\n".join(f"| {i} | b | c |" if i % 5 else " plain" for i in range(n))
    began = time.perf_counter()
    df = spark.createDataFrame([(text, rows, [1] * 1000)], "t string, r string, n array<int>")
    got = df.select(M.break_paragraphs(F.col("t")).alias("t"), B.runs(F.col("r")).alias("r"), X.sums_before(F.col("n")).alias("n")).first()
    assert time.perf_counter() - began < 120
    assert len(got.r) == n // 5 and all(len(x) == 4 for x in got.r) and got.r[1][0] == "| 6 | b | c |"
    assert got.n == list(range(1000))
    # of ten lines: list | plain | code of four | plain, plain -> a blank line before each but the lines of code and lists
    assert got.t.split("\n")[:20] == ["- item", "- item", "- item", "", "line 3", "", "```", "line 5", "line 6", "```", "", "line 8", "", "line 9", "", "- item", "- item", "- item", "", "line 13"]


def test_runs_of_rows(spark):
    from lectern.operators import tables as B

    said = ["", "a\tb\tc", "x\n| a | b |\n|-|-|\n\ny\n| c | d |\n  | e | f |  ", "\n\n| a | b |\n\n\n", None]
    got = [r.r for r in spark.createDataFrame([(t,) for t in said], "t string").select(B.runs(F.col("t")).alias("r")).collect()]
    assert got == [[], [["a\tb\tc"]], [["| a | b |", "|-|-|"], ["| c | d |", "| e | f |"]], [["| a | b |"]], []]
