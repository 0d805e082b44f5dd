"""Queries against their SQL on rows that the small tables lack."""

import duckdb
import pytest

from lectern import catalog


@pytest.fixture
def differing(spark, tmp_path):
    """The rows of a query that its SQL has not, and the other way round, over one table made here."""

    def run(name, table, columns, rows):
        c = duckdb.connect()
        c.execute("set threads = 1")  # rows that the SQL leaves tied stay as they stand in the table
        c.execute(f"create table t ({columns})")
        c.executemany(f"insert into t values ({', '.join('?' * len(rows[0]))})", rows)
        c.execute(f"copy t to '{tmp_path}/{table}.parquet' (format parquet)")
        c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        ours = sorted(map(tuple, df.collect()), key=repr)
        theirs = sorted(c.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall(), key=repr)
        assert theirs
        return [x for x in ours if x not in theirs], [x for x in theirs if x not in ours]

    return run


LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_returnflag varchar"


def test_images_of_parts_beyond_a_hundred_thousand(differing):
    rows = [(1, 400_005, 1, 3, 1.0, "N"), (1, 5, 1, 7, 1.0, "N"), (1, 700_000, 1, 1, 1.0, "A"), (2, 9, 1, 3, 1.0, "N")]
    assert differing("pages_assembled", "lineitem", LINES, rows) == ([], [])


def test_texts_of_one_block_number_stand_as_in_the_table(differing):
    rows = [(1, 200_007, 1, 1, 1.0, "N"), (1, 100_007, 1, 2, 1.0, "A"), (1, 7, 1, 3, 1.0, "N"), (1, 7, 2, 3, 1.0, "A"), (2, 3, 1, 1, 1.0, "N"), (2, 3, 1, 1, 1.0, "A")]
    assert differing("texts_removed", "lineitem", LINES, rows) == ([], [])


PAGES = "page_id bigint, url varchar, html varchar"


def test_titles_cut_off_within_a_reference(differing):
    titles = ["a &amp;&amp", "b &quot;c&quot", "d &copy", "&amp;quot; e &middot; f", "g & h &am", "&amp;amp; i", "&ampj; k", "&#x l; &#38 m"]
    rows = [(i, "https://x.org/a", f"<html><head><title>{t}</title></head><body>&amp</body></html>") for i, t in enumerate(titles)]
    assert differing("inspect_pages", "pages", PAGES, rows) == ([], [])


def test_main_content_short_deep_or_missing(differing):
    pages = ["<body><article><h1>short</h1></article><p>more than ten characters</p></body>", "<body><article>" + "<b>" * 3000 + "deep</article></body>", "<body><p>no place</p></body>", "text alone", None]
    assert differing("main_content", "pages", PAGES, [(i, "https://x.org/a", h) for i, h in enumerate(pages)]) == ([], [])
