"""Boxes on pages: containment, captions, suppression, reading order, assembly.

A box is struct<x0,y0,x1,y1 double> from the top left. Spatial joins are equi-joins on (doc_id, page) with the geometry as a residual
condition, so a shuffle by document and page serves them all, and no pair of boxes of different pages is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X

PAGE = ["doc_id", "page"]


def box(x0, y0, x1, y1) -> Column:
    c = lambda v, n: (v if isinstance(v, Column) else F.col(v)).cast("double").alias(n)
    return F.struct(c(x0, "x0"), c(y0, "y0"), c(x1, "x1"), c(y1, "y1"))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """The area that both cover."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    return side("x0", "x1") * side("y0", "y1")


def inside(text: Column, figure: Column, threshold: float = 0.6) -> Column:
    """Whether that share of the text's box lies in the figure's; never for an empty box."""
    return F.coalesce((area(text) > 0) & (overlap(text, figure) / F.when(area(text) > 0, area(text)) >= threshold), F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))


def top_left(b: Column, height: Column, origin: Column) -> Column:
    """The box with its origin at the top left; other origins than BOTTOMLEFT, or no height, leave it as it is."""
    turned = F.struct(b["x0"].alias("x0"), (height - b["y0"]).alias("y0"), b["x1"].alias("x1"), (height - b["y1"]).alias("y1"))
    return F.when((origin == "BOTTOMLEFT") & (height > 0), turned).otherwise(b)


def zero_based(page: Column) -> Column:
    return F.greatest(F.lit(0), page.try_cast("int") - 1)


def figure_texts(blocks: DataFrame, figures: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Distinct texts (doc_id, page, text) of blocks inside a figure of their page; captions are exempt."""
    kept = blocks.where(~S.is_caption(F.col("text")))
    f = figures.select(*PAGE, F.col("bbox").alias("fbox"))
    on = [kept[c] == f[c] for c in PAGE]
    found = kept.join(f, [*on, inside(F.col("bbox"), F.col("fbox"), threshold)], "left_semi")
    return found.select(*PAGE, X.strip(F.col("text")).alias("text")).where("text <> ''").distinct()


def without_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """docs (doc_id, markdown) without paragraphs that are one of the document's texts (doc_id, text)."""
    listed = texts.groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    kept = F.filter(F.split("markdown", "\n\n+", -1), lambda p: ~F.coalesce(F.array_contains("texts", X.strip(p)), F.lit(False)))
    return docs.join(listed, "doc_id", "left").select("doc_id", F.array_join(kept, "\n\n").alias("markdown"))


def captions(targets: DataFrame, blocks: DataFrame, above: bool = True, tolerance: float = 30.0, slack: float = 5.0) -> DataFrame:
    """targets with the nearest caption on their page (120 characters at most), or null.

    A caption stands below the target, or above it, within the tolerance, overlaps it in width, and looks like one; of equally
    near ones the first counts. Distances under -slack don't count.
    """
    b = blocks.where(S.is_caption(F.col("text"))).select(*[F.col(c).alias(f"b_{c}") for c in PAGE], "block_no", F.col("bbox").alias("b_bbox"), "text")
    t = targets
    far = F.lit(tolerance + 1)
    gap = lambda d: F.when(d >= -slack, d).otherwise(far)
    below = gap(F.col("b_bbox.y0") - F.col("bbox.y1"))
    distance = F.least(below, gap(F.col("bbox.y0") - F.col("b_bbox.y1"))) if above else below
    near = (F.least(F.col("b_bbox.x1"), F.col("bbox.x1")) - F.greatest(F.col("b_bbox.x0"), F.col("bbox.x0")) > 0) & (distance <= tolerance)
    on = [t[c] == b[f"b_{c}"] for c in PAGE]
    caption = F.substring(X.strip(F.regexp_replace(X.strip(F.col("text")), "\n+", " ")), 1, 120)
    best = t.join(b, [*on, near], "left").groupBy(*PAGE, "target_no").agg(F.min_by(caption, F.struct(distance, F.col("block_no"))).alias("caption"))
    return t.join(best, [*PAGE, "target_no"])


def uncovered(blocks: DataFrame, regions: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks that no table region touches, and that lie in no figure."""
    r, f = regions.select(*PAGE, F.col("bbox").alias("rbox")), figures.select(*PAGE, F.col("bbox").alias("fbox"))
    out = blocks.join(r, [*[blocks[c] == r[c] for c in PAGE], intersects(F.col("bbox"), F.col("rbox"))], "left_anti")
    return out.join(f, [*[out[c] == f[c] for c in PAGE], inside(F.col("bbox"), F.col("fbox"))], "left_anti")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with their place in the document, by page, top, left and number."""
    w = Window.partitionBy("doc_id").orderBy("page", F.col("bbox.y0"), F.col("bbox.x0"), "block_no")
    return blocks.withColumn("reading_order", X.bigint(F.row_number().over(w) - 1))


def title_regions(titles: DataFrame, height: float = 842.0) -> DataFrame:
    """For each title block the strip of the page below it: from its bottom to the next title's top, or near the page's end."""
    following = F.lead("bbox.y0").over(Window.partitionBy(*PAGE).orderBy(F.col("bbox.y0"), "block_no"))
    return titles.withColumn("top", F.col("bbox.y1") + 2).withColumn("bottom", F.coalesce(following - 5, F.lit(height - 40)))


def region_kind(is_image: Column, font_size: Column) -> Column:
    return F.when(is_image, "figure").when(font_size > 14, "header").otherwise("text")


def block_type(label: Column) -> Column:
    """struct<block_type, heading_level> of a label."""
    kind = F.when(label.isin("title", "section_header"), "heading").when(label == "list_item", "list_item").when(label == "footnote", "footnote").otherwise("paragraph")
    return F.struct(kind.alias("block_type"), F.when(label == "title", 1).when(label == "section_header", 2).alias("heading_level"))


def script_type(size: Column, y: Column, baseline: Column, normal: Column) -> Column:
    """normal, superscript or subscript, by size and height on the line."""
    ratio = size / F.when(normal > 0, normal)
    return F.when(ratio.isNull() | (ratio >= 0.75), "normal").when(y - baseline < -2, "superscript").when(y - baseline > 2, "subscript").when(ratio < 0.65, "superscript").otherwise("normal")


def is_block_formula(b: Column, width: Column, has_math: Column, tolerance: float = 0.15) -> Column:
    return has_math & (F.abs((b["x0"] + b["x1"]) / 2 - width / 2) < width * tolerance)


def equation_number(text: Column) -> Column:
    found = F.regexp_extract(text, r"\((\d+(?:\.\d+)?)\)\s*$", 1)
    return F.when(found != "", found)


def render(kind: Column, content: Column, level: Column, label: Column) -> Column:
    """One element as Markdown."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), content))
        .when(kind == "list_item", F.concat(F.lit("- "), content))
        .when(kind == "formula", F.concat(F.lit("$$\n"), content, F.lit("\n$$")))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(label, F.lit("")), F.lit("\n"), content, F.lit("\n```")))
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce(label, F.lit("")), F.lit("]("), content, F.lit(")")))
        .otherwise(content)
    )


#: The order of kinds at the same place.
KINDS = ("text", "table", "formula", "code", "image")


def assemble(elements: DataFrame) -> DataFrame:
    """doc_id and the Markdown of its elements (doc_id, page, bbox or null, reading_order, kind_no, pos, markdown) in reading order.

    Elements without a box stand at 100 times their ordinal. One shuffle by document; the text is put together there.
    """
    place = F.struct(
        F.greatest(F.lit(0), F.col("page")).alias("page"),
        F.coalesce(F.col("bbox.y0"), F.col("reading_order") * 100.0).alias("y"),
        F.coalesce(F.col("bbox.x0"), F.lit(0.0)).alias("x"),
        F.col("reading_order").alias("ordinal"),
        F.col("kind_no").alias("kind_no"),
        F.col("pos").alias("pos"),
        F.col("markdown").alias("markdown"),
    )
    parts = F.filter(F.transform(F.array_sort(F.collect_list(place)), lambda e: e["markdown"]), lambda m: X.strip(m) != "")
    return elements.groupBy("doc_id").agg(F.array_join(parts, "\n\n").alias("markdown"))
