"""The queries on whole texts against plain Python, with all Markdown of a text far behind its 80th character."""

import re

import pytest

from lectern import catalog
from lectern.queries.text import MARKDOWN

TEXT = "plain words " * 40 + "\n# Late\n* item\n> quoted\n| a |  b|\n|---|---|\n| 1 | 2 |\n![i](late.png) and [l](http://late.org)\n$$z$$\nend  of , all.Then more"


@pytest.fixture(scope="module")
def there(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(1, TEXT, "en", "s", len(TEXT)), (4, TEXT * 30, "de", "t", 30 * len(TEXT))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", f"{MARKDOWN} as md").collect()
    assert all(r.md.endswith("\n" + r.text) for r in rows)
    return sf, {r.doc_id: r for r in rows}


def run(spark, sf, name):
    return {r.doc_id: r for r in catalog.QUERIES[name](spark, sf).collect()}


def test_counts(spark, there):
    sf, docs = there
    signals, data, score = (run(spark, sf, n) for n in ("quality_signals", "page_metadata", "heuristic_score"))
    for d, r in docs.items():
        md, s, m = r.md, signals[d], data[d]
        count = lambda p: len(re.findall(p, md))
        wanted = (len(md.split()), len(md), md.count("\n") + 1, count(r"(?m)^#{1,6}\s+"), count(r"(?m)^[ \t]*\|"), count(r"\$\$(?:.|\n)+?\$\$"), count(r"!\[.*?\]\(.*?\)"))
        assert wanted == (s.word_count, s.char_count, s.line_count, s.heading_count, s.table_lines, s.formula_block_count, s.image_count)
        assert (m.word_count, m.character_count, m.image_ref_count) == (wanted[0], wanted[1], wanted[6]) and m.link_count >= count(r"\[l\]\(http")
    assert score[4].score > score[1].score + 29 * 5
    lines = {r.line_class: r.n for r in catalog.QUERIES["md_line_classes"](spark, sf).collect()}
    every = [x for r in docs.values() for x in r.md.split("\n")]
    assert sum(lines.values()) == len(every) and lines["heading"] == sum(bool(re.match(r"#{1,6}\s", x)) for x in every)


def test_passes(spark, there):
    sf, docs = there
    late = {"to_text": ["late.png", "# Late"], "lists": ["* item"], "tables": ["|  b|"], "format": ["* item", "|  b|"]}
    for name, gone in late.items():
        got = run(spark, sf, f"md_{name}")
        assert all(not any(x in got[d][1] for x in gone) and got[d][1].count("Then more") >= r.text.count("Then more") for d, r in docs.items()), name
    for name in ("links", "headings", "quotes", "clean_up"):
        got = run(spark, sf, f"md_{name}")
        assert all(got[d][1].count("plain words") == r.text.count("plain words") for d, r in docs.items()), name
    tidy = run(spark, sf, "md_typography")
    for d, r in docs.items():
        t = re.sub(r" {2,}", " ", f"{r.lang} -- a  b , c.Then {r.text}")
        assert tidy[d].tidy.count("of, all. Then more") == t.count("of , all.Then more")
    assert all(r.structured for r in run(spark, sf, "markdown_structure").values())
