"""The library's operators as stage tools, the builders that gather stages, and the two plans made of them.

A tool takes and gives one DataFrame, so any plan over these names is one query. Engines' output enters as tables: a tool named after an engine
normalises what that engine gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markdown import format_markdown
from ..operators import conversion as C
from ..operators import documents as D
from ..operators import engines as E
from ..operators import layout as Y
from ..operators import tables as B
from ..operators import web as W
from .dag import Choice, Stage, compile_plan, register, register_skill

# Tools for laid-out documents.
register("text_extraction.pymupdf")(Y.reading_order)
register("text_extraction.pypdf")(E.page_blocks)
register("table_extraction.docling")(E.structured_tables)
register("table_extraction.pymupdf")(E.gated_tables)
register("table_extraction.camelot")(E.gated_tables)
register("table_extraction.pdfplumber")(E.cell_tables)
register("table_extraction.text")(lambda docs: B.tables_in_text(docs, "doc_id", "text"))
register("formula_extraction.mineru")(E.formulas)
register("formula_extraction.docling")(E.formulas)
register("formula_extraction.heuristic")(E.block_formulas)
register("code_detection.docling")(E.code_blocks)
register("code_detection.marker")(E.code_blocks)
register("image_extraction.pymupdf")(E.images_in_order)
register("preprocessing.scan")(D.characteristics)


@register("text_extraction.markdown")
def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, markdown)."""
    return docs.select("doc_id", F.lit(0).alias("page"), F.inline(E.paragraph_blocks(F.col("markdown"))))


@register("code_detection.algorithm")
def algorithm_code(docs: DataFrame) -> DataFrame:
    """Pseudo code in documents (doc_id, text)."""
    return docs.select("doc_id", F.inline(D.algorithm_regions(F.col("text"))))


@register("assembly.text")
def text_assembly(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) as Markdown."""
    return docs.select("doc_id", C.to_markdown(F.col("text")).alias("markdown"))


@register("assembly.default")
def default_assembly(stages: DataFrame) -> DataFrame:
    """Documents with their stages side by side: the extracted text as Markdown."""
    return stages.select("doc_id", C.to_markdown(F.col("text_extraction.text")).alias("markdown"))


# Tools for pages.
register("discover.links")(W.discover_links)
register("audit.links")(W.audit)


@register("fetch.table")
def fetched(pages: DataFrame) -> DataFrame:
    """Pages as they were fetched: page_id, url, html."""
    return pages.select("page_id", "url", "html")


@register("main_content.heuristic")
def main_content(pages: DataFrame) -> DataFrame:
    """Pages with the HTML of their main content, and why it can't be right."""
    found = W.perceive(pages.withColumn("raw", F.col("html")), "title", "main_html")
    return found.select("page_id", "url", "title", F.col("main_html").alias("html"), C.lost_images(F.col("raw"), F.col("main_html")).alias("problem"))


@register("markdown.default")
def rendered(pages: DataFrame) -> DataFrame:
    return W.perceive(pages, "markdown")


@register("markdown.fallback")
def rendered_plainly(pages: DataFrame) -> DataFrame:
    return W.perceive(pages, "plain_markdown").withColumnRenamed("plain_markdown", "markdown")


@register("formatting.default")
def formatted(pages: DataFrame) -> DataFrame:
    return pages.withColumn("markdown", format_markdown(F.col("markdown")))


#: Gather stages for those that need several.
BUILDERS = {
    "assembly_input": lambda results: C.gathered(results, "preprocessing", ("layout_analysis", "text_extraction", "table_extraction", "formula_extraction", "image_extraction", "code_detection")),
    "asset_input": lambda results: C.gathered(results, "assembly", ("image_extraction", "preprocessing")),
}

WEBPAGE = [
    Stage("fetch", (Choice("table", 1),)),
    Stage("main_content", (Choice("heuristic", 1),)),
    Stage("markdown", (Choice("default", 1), Choice("fallback", 2))),
    Stage("formatting", (Choice("default", 1),)),
]


@register_skill("webpage_to_markdown", "Pages as formatted Markdown")
def run_webpage(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as formatted Markdown, by the plan above."""
    run = compile_plan(WEBPAGE, pages)
    if run.last is None:
        raise ValueError(f"the plan failed: {run.errors}")
    return run.last
