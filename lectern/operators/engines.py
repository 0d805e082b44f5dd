"""What engines return, in one form: boxes, text blocks, tables, formulas, code, images, layout regions, results.

Engines run elsewhere; their output enters as columns and tables. Everything is a projection, or one window or join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.signals import INLINE_FORMULA
from .tables import markdown_of_cells


def _box(*sides: Column) -> Column:
    return F.struct(*[s.cast("double").alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)])


def _whole(*sides: Column) -> Column:
    """A box of four numbers, or null if one is missing."""
    there = sides[0].isNotNull()
    for s in sides[1:]:
        there = there & s.isNotNull()
    return F.when(there, _box(*sides))


def box_of(b: Column) -> Column:
    """The box of struct<l,t,r,b,x0,y0,x1,y1>: by the first four if all are there, else by the last four, else null."""
    return F.coalesce(_whole(b["l"], b["t"], b["r"], b["b"]), _whole(b["x0"], b["y0"], b["x1"], b["y1"]))


def box_of_json(item: Column) -> Column:
    """The box in an item's JSON: four numbers in a list, or by names (0 where one is missing); null if there is none or a value is no number."""
    value = F.try_parse_json(item)
    number = lambda path: F.try_variant_get(value, path, "double")
    given = lambda path: F.try_variant_get(value, path, "string").isNotNull()

    def side(name: str, other: str) -> Column:
        return F.when(given(f"$.bbox.{name}"), number(f"$.bbox.{name}")).when(given(f"$.bbox.{other}"), number(f"$.bbox.{other}")).otherwise(F.lit(0.0))

    kind = F.schema_of_variant(F.try_variant_get(value, "$.bbox", "variant"))
    listed = _whole(*[number(f"$.bbox[{i}]") for i in range(4)])
    named = _whole(side("x0", "left"), side("y0", "top"), side("x1", "right"), side("y1", "bottom"))
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), named)


def paragraph_blocks(markdown: Column) -> Column:
    """array<struct<text, block_type, heading_level, reading_order>> of Markdown's paragraphs: headings without their marks, list items, the rest."""
    kept = F.filter(F.transform(F.split(X.or_empty(markdown), "\n\n", -1), X.strip), lambda p: p != "")

    def one(p: Column, i: Column) -> Column:
        marks, heading = F.regexp_extract(p, r"^(#{1,6})\s+.", 1), F.regexp_extract(p, r"^#{1,6}\s+(.+)", 1)
        text = F.when(marks != "", heading).otherwise(p)
        kind = F.when(text.rlike(r"^\s*(?:[-*+]|\d+\.)\s"), "list_item").when(marks != "", "heading").otherwise("paragraph")
        return F.struct(text.alias("text"), kind.alias("block_type"), F.when(marks != "", F.length(marks)).alias("heading_level"), X.bigint(i).alias("reading_order"))

    return F.transform(kept, one)


def page_blocks(pages: DataFrame) -> DataFrame:
    """One paragraph for each page (doc_id, page, text) that has text."""
    rows = pages.select("doc_id", "page", X.strip(X.or_empty(F.col("text"))).alias("text")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("page")
    return rows.select("*", F.lit("paragraph").alias("block_type"), X.bigint(F.row_number().over(order) - 1).alias("reading_order"))


def _numbered(found: DataFrame, prefix: str) -> DataFrame:
    """found (doc_id, pos, page, ...) with an id by its place in the document; a missing page is the first."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    name = F.concat(F.lit(f"{prefix}_"), (F.row_number().over(order) - 1).cast("string"))
    return found.select(name.alias("id"), *[F.coalesce("page", F.lit(0)).alias("page") if c == "page" else F.col(c) for c in found.columns if c != "pos"])


def structured_tables(found: DataFrame) -> DataFrame:
    """Tables that an engine gives whole: (doc_id, pos, page, markdown, rows, columns, bbox, caption)."""
    return _numbered(found, "tbl")


def cell_tables(found: DataFrame) -> DataFrame:
    """Tables that an engine gives as cells: (doc_id, pos, page, cells); the first row is the header and doesn't count. Empty ones are left out."""
    cells = F.transform("cells", lambda r: F.transform(r, X.or_empty))
    rows = found.where("size(cells) > 0").withColumn("cells", cells)
    head = F.get("cells", 0)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), F.size(head)))
    shown = F.concat(F.array(line(head), rule), F.transform(F.slice("cells", F.lit(2), F.size("cells")), line))
    made = rows.select("doc_id", "pos", "page", F.array_join(shown, "\n").alias("markdown"), X.bigint(F.size("cells") - 1).alias("rows"), X.bigint(F.size(head)).alias("columns"), head.alias("headers"))
    return _numbered(made, "tbl")


def gated_tables(found: DataFrame) -> DataFrame:
    """Tables out of cells found by geometry: columns and rows merged, those that pass the quality gate, as Markdown, with their captions."""
    from .documents import merged_cells
    from .tables import quality

    rows = found.withColumn("cells", merged_cells(F.col("cells"))).where("size(cells) > 0").withColumn("gate", quality(F.col("cells"))).where("gate.passed")
    return _numbered(rows.select("doc_id", "pos", "page", markdown_of_cells(F.col("cells")).alias("markdown"), F.col("gate.rows").alias("rows"), F.col("gate.cols").alias("columns"), "caption"), "tbl")


def formulas(found: DataFrame) -> DataFrame:
    """Formulas of an engine: (doc_id, pos, page, latex, formula_type, original_text)."""
    return _numbered(found, "formula")


def formula_counts(found: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("formula_type") == k)
    return found.groupBy("doc_id").agg(F.count("*").alias("formulas"), kind("inline").alias("inline_count"), kind("block").alias("block_count"))


def block_formulas(found: DataFrame) -> DataFrame:
    """The block formulas, for documents that have nothing better."""
    return found.where("formula_type = 'block'")


def dual_formulas(enriched: Column, analysed: Column) -> Column:
    """array<struct<latex, formula_type>>: what stands in the Markdown of a formula model, or else what fonts have shown.

    Blocks come first; empty ones, and inline ones of a single character, are left out.
    """
    of = lambda p, kind: F.transform(F.regexp_extract_all(enriched, F.lit(p), F.lit(1)), lambda x: F.struct(X.strip(x).alias("latex"), F.lit(kind).alias("formula_type")))
    blocks = F.filter(of(r"\$\$([\s\S]+?)\$\$", "block"), lambda f: f["latex"] != "")
    inline = F.filter(of(INLINE_FORMULA, "inline"), lambda f: F.length(f["latex"]) > 1)
    return F.when(enriched.isNotNull(), F.concat(blocks, inline)).otherwise(analysed)


def code_blocks(found: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Code of an engine: (doc_id, pos, page, code, language); an engine's find is sure but for a tenth."""
    return _numbered(found, "code").withColumn("confidence", F.lit(confidence))


def layout_regions(tables: Column, figures: Column, formulas_: Column, code: Column, placed: bool = True) -> Column:
    """array<struct<region_type, page, bbox, reading_order>>: tables, figures, formulas and code in turn, from arrays of struct<page, bbox>.

    Formulas and code have no box of their own (zeros); without `placed` nothing has.
    """
    zeros = _box(*[F.lit(0.0)] * 4)

    def of(items: Column, kind: str, boxed: bool) -> Column:
        bbox = lambda x: F.coalesce(x["bbox"], zeros) if boxed and placed else zeros
        none = F.array().cast("array<struct<region_type:string,page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
        return F.coalesce(F.transform(items, lambda x: F.struct(F.lit(kind).alias("region_type"), F.coalesce(x["page"], F.lit(0)).alias("page"), bbox(x).alias("bbox"))), none)

    every = F.concat(of(tables, "table", True), of(figures, "figure", True), of(formulas_, "formula", False), of(code, "code", False))
    return F.transform(every, lambda r, i: F.struct(r["region_type"].alias("region_type"), r["page"].alias("page"), r["bbox"].alias("bbox"), X.bigint(i).alias("reading_order")))


def images_in_order(images: DataFrame) -> DataFrame:
    """images (doc_id, page, pos, bbox, ...) with their place on the page: from the top (no box: at it), then as found."""
    order = Window.partitionBy("doc_id", "page").orderBy(F.coalesce("bbox.y0", F.lit(0.0)), "pos")
    return images.withColumn("reading_order", X.bigint(F.row_number().over(order) - 1))


def enriched_tables(tables: Column, blocks: Column) -> Column:
    """tables (array of struct<markdown, page, caption>) with page and caption of the nth table block (struct<block_type, page, caption>), where it has them."""
    found = F.filter(blocks, lambda b: F.lower(X.or_empty(b["block_type"])).contains("table"))
    caption = lambda t, b: F.coalesce(F.when(X.or_empty(b["caption"]) != "", b["caption"]), t["caption"])
    one = lambda b: lambda t, i: F.struct(t["markdown"].alias("markdown"), F.coalesce(F.get(b, i)["page"], t["page"]).alias("page"), caption(t, F.get(b, i)).alias("caption"))
    return X.let(found, lambda b: F.transform(tables, one(b)))


def page_tables(pages: DataFrame) -> DataFrame:
    """The tables of each page (doc_id, page, geometry, in_text: arrays): those that geometry shows, or else those in its text."""
    return pages.select("doc_id", "page", F.when(F.size("geometry") > 0, F.col("geometry")).otherwise(F.col("in_text")).alias("tables"))


# What engines can't do; they can do everything else.
FEATURES = ("page_range", "embed_images", "code_blocks", "table_structure", "formula_extraction", "gpu_acceleration")
LACKS = {"marker": ("page_range",), "mineru": ("code_blocks",)}


def supports(engine: Column, feature: Column) -> Column:
    """Whether an engine has a feature; unknown features it has not."""
    lacking = F.lit(False)
    for name, features in LACKS.items():
        lacking = lacking | ((engine == name) & feature.isin(*features))
    return feature.isin(*FEATURES) & ~lacking


# Batch sizes by device, from so many GB of memory on, and below.
BATCHES = {"mps": ((48, 32), (24, 16), (12, 12), (0, 8)), "cuda": ((24, 64), (12, 32), (8, 16), (0, 8)), "xpu": ((16, 16), (8, 12), (0, 8))}


def batch_sizes(device: Column, memory: Column) -> Column:
    """struct<ocr, layout, table>: 4 each without a GPU; 8, 8 and 4 if its memory is unknown."""
    size = F.when(~device.isin(*BATCHES), F.lit(4))
    size = size.when(memory.isNull(), F.lit(8))
    for name, steps in BATCHES.items():
        for least, batch in steps:
            size = size.when((device == name) & (memory >= least) if least else device == name, F.lit(batch))
    return X.let(size, lambda n: F.struct(n.alias("ocr"), n.alias("layout"), F.greatest(F.lit(4), F.floor(n / 2).cast("int")).alias("table")))


def result(engine: Column, source: Column, markdown: Column, pages: Column, metadata: Column, content: Column, form: str = "markdown", with_metadata: bool = True) -> Column:
    """The standard result of an engine: its text (content if it was worked on, else the Markdown), with counts."""
    text = X.or_empty(F.coalesce(content, markdown))
    parts = [F.lit(True).alias("success"), text.alias("text"), source.alias("source"), engine.alias("method_used"), F.lit(form).alias("output_format"), pages.alias("pages_processed"), X.word_count(text).alias("word_count"), X.bigint(F.length(text)).alias("character_count")]
    parts += [text.alias("markdown")] if form == "markdown" else []
    return F.struct(*parts, *([metadata.alias("metadata")] if with_metadata else []))


def rich_counts(formulas_: Column, code: Column, tables: Column, images: Column) -> Column:
    """struct of four counts; what failed (null) counts as none, and is named in errors."""
    given = {"formula": formulas_, "code_block": code, "table": tables, "image": images}
    count = lambda x: X.bigint(F.when(x.isNull(), 0).otherwise(F.size(x)))
    errors = F.array_compact(F.array(*[F.when(x.isNull(), F.lit(name)) for name, x in given.items()]))
    return F.struct(*[count(x).alias(f"{name}_count") for name, x in given.items()], errors.alias("errors"))


def stage_summary(records: Column) -> Column:
    """One line of stage records (struct<stage, method, ms, success>)."""
    one = lambda r: F.concat(r["stage"], F.lit("("), F.when(X.or_empty(r["method"]) == "", "-").otherwise(r["method"]), F.lit(","), F.format_string("%.0f", r["ms"].cast("double")), F.lit("ms,"), F.when(r["success"], "ok").otherwise("fail"), F.lit(")"))
    return F.when(F.size(records) > 0, F.array_join(F.transform(records, one), "→")).otherwise("(no-stage)")


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; of equal keys the second's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def arguments_hash(arguments: Column) -> Column:
    """SHA-1 of a map's JSON with its keys in order; a map without any has a name of its own."""
    quoted = lambda s: F.concat(F.lit('"'), F.regexp_replace(s, r'(["\\])', r"\\$1"), F.lit('"'))
    entries = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.when(F.size(F.map_keys(arguments)) > 0, F.sha1(F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")))).otherwise("__empty__")
