"""Wiring of stages, and the page operators on a stream."""

from pyspark.sql import functions as F

from lectern.plans import dag
from lectern.streaming import pages as S


def _add(n):
    return lambda df: df.withColumn("x", F.col("x") + n)


def test_routing(spark):
    dag.register("one")(_add(1))
    dag.register("ten")(_add(10))
    dag.register("b.ten")(_add(20))
    start = spark.createDataFrame([(0,)], "x int")
    choice = dag.Choice
    stages = [
        dag.Stage("a", (choice("ten", 5), choice("one", 1))),
        dag.Stage("b", (choice("ten"),), parallel=True),
        dag.Stage("c", (choice("missing"),), parallel=True),
        dag.Stage("d", (choice("one"),), input_from="a"),
        dag.Stage("e", (choice("one"),), input_builder="both"),
    ]
    run = dag.compile_plan(stages, start, {"both": lambda r: r["b"].union(r["d"])})
    assert run.used == {"a": "one", "b": "ten", "d": "one", "e": "one"} and run.errors == {"c": "no usable tool"}
    assert sorted(r.x for r in run.last.collect()) == [3, 22]
    assert [len(g) for g in dag.groups(stages)] == [1, 2, 1, 1]
    closed = dag.compile_plan(stages, start, gates={"one": False})
    assert closed.used["a"] == "ten" and closed.errors["d"] == "no usable tool" and closed.last is None


def test_config():
    assert dag.flatten_config({"a": {"b": 1, "c": {"d": 2}}, "a_b": 9, "pipeline": {"x": {}}}) == {"a_b": 9, "a_c_d": 2, "pipeline": {"x": {}}}
    assert dag.deep_merge({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 3, "c": None}, "l": []}) == {"a": {"b": 3, "c": 2}, "l": []}


def test_stream(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.read_pages(spark, str(tmp_path / "in"), 1)
    batch = S.page_links(spark.read.parquet(f"{tiny}/pages.parquet"))
    assert sorted(S.drained(S.page_links(stream), "stream_links").collect()) == sorted(batch.collect())
    counts = S.drained(S.link_counts(stream), "stream_counts", "complete")
    assert counts.agg(F.sum("links")).first()[0] == batch.count()
    seen = S.first_seen(stream.withColumn("at", F.lit("2024-01-01").cast("timestamp")).unionByName(stream.withColumn("at", F.lit("2024-01-01").cast("timestamp"))), "at")
    assert S.drained(seen.select("url"), "stream_urls").count() == spark.read.parquet(f"{tiny}/pages.parquet").select("url").distinct().count()


def test_library_tools(spark):
    """The library's operators run as tools, gathered by a builder; a skill is found by its name."""
    from lectern.plans import tools

    assert {"text_extraction.pypdf", "table_extraction.pdfplumber", "assembly.default", "markdown.fallback"} <= set(dag.tool_names())
    docs = spark.createDataFrame([(1, "THE TITLE\n\nsome words\nof it"), (2, None)], "doc_id long, text string")
    dag.register("preprocessing.keep")(lambda d: d)
    dag.register("text_extraction.keep")(lambda d: d.where("text is not null"))
    stages = [dag.Stage("preprocessing", (dag.Choice("keep"),)), dag.Stage("text_extraction", (dag.Choice("keep"),)), dag.Stage("assembly", (dag.Choice("default"),), input_builder="assembly_input")]
    run = dag.compile_plan(stages, docs, tools.BUILDERS)
    assert not run.errors and {r.doc_id: r.markdown for r in run.last.collect()} == {1: "# THE TITLE\n\nsome words of it", 2: ""}
    lost = dag.compile_plan(stages[1:], docs, {"assembly_input": lambda results: None})
    assert "assembly" in lost.errors and lost.last is None

    pages = spark.createDataFrame([(2**53 + 1, "https://x.org/a", "<title>t</title><main><h1>Head</h1><p>one -- two</p></main>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in dag.find_skill("webpage_to_markdown")(pages).collect()}
    assert set(got) == {2**53 + 1, None} and got[2**53 + 1].markdown == "# Head\n\none — two" and "webpage_to_markdown" in dag.skills()
