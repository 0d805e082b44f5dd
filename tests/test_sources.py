"""Files in, files out."""

from lectern.sources import tables as S


def test_html_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.html").write_text("<title>é</title>", encoding="utf-8")
    (tmp_path / "y.txt").write_text("no")
    row = S.read_html_files(spark, f"file://{tmp_path}").first()
    assert row.html == "<title>é</title>" and row.url == "https://localhost/x.html" and len(row.fingerprint) == 64


def test_bundles(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# a", "t"), (2, None, None)], "doc_id long, markdown string, title string")
    S.write_bundles(docs, str(tmp_path / "out"), 1)
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].metadata == '{"title":"t"}' and got[2].markdown is None
    S.write_text(docs, "markdown", str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["", "# a"]


def test_pages_by_schema(spark, tiny):
    assert S.read_pages(spark, f"{tiny}/pages.parquet").count() == spark.read.parquet(f"{tiny}/pages.parquet").count()
