"""Whole documents to Markdown: pseudo code merged, pages assembled, placeholders salvaged, images embedded, stages gathered."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import latex as L
from ..functions import signals as S
from ..functions import text as X
from ..functions.markdown import code_fence
from .assets import FORMULA_PLACEHOLDER
from .documents import ALONE, algorithm_regions, simple_markdown
from .layout import PAGE, inside, intersects


def merged_algorithms(text: Column) -> Column:
    """A text with each region of pseudo code as one fence, where the region begins; page marks inside a region go."""

    def merged(parts: Column, regions: Column) -> Column:
        first = lambda i: F.get(F.filter(regions, lambda r: r["start_idx"] == i), 0)
        within = lambda i: F.exists(regions, lambda r: (r["start_idx"] <= i) & (i < r["end_idx"]))
        held = lambda r: F.filter(F.transform(F.slice(parts, (r["start_idx"] + 1).cast("int"), (r["end_idx"] - r["start_idx"]).cast("int")), X.strip), lambda p: (p != "") & ~p.startswith("<!--"))

        def one(p: Column, i: Column) -> Column:
            region = first(i)
            fence = X.let(held(region), lambda h: F.when(F.size(h) > 0, code_fence(F.array_join(h, "\n"))))
            return F.when(region.isNotNull(), fence).when(~within(i), p)

        return F.array_join(F.array_compact(F.transform(parts, one)), "\n\n")

    found = algorithm_regions(text)
    return X.let(F.split(X.or_empty(text), "\n\n", -1), lambda parts: X.let(found, lambda r: F.when(F.size(r) > 0, merged(parts, r)).otherwise(X.or_empty(text))))


def to_markdown(text: Column) -> Column:
    """Markdown of extracted text: regions of pseudo code become fences, lines of a paragraph one, tables, images and page marks stay.

    Where that shows no structure, short lines that look like titles become headings instead.
    """

    def one(p: Column) -> Column:
        stays = p.startswith("<!--") | p.startswith("![") | p.startswith("|") | (p.startswith("**") & p.contains("\n|")) | p.startswith("```algorithm\n")
        return F.when(stays, p).when(S.algorithm_score(p) >= ALONE, code_fence(p)).otherwise(F.replace(p, F.lit("\n"), F.lit(" ")))

    def chosen(whole: Column) -> Column:
        parts = F.filter(F.transform(F.split(whole, "\n\n", -1), X.strip), lambda p: p != "")
        made = F.array_join(F.transform(parts, one), "\n\n")
        return X.let(made, lambda m: F.when(S.has_markdown(m), m).otherwise(simple_markdown(whole)))

    return X.let(merged_algorithms(text), chosen)


def page_markdown(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, markdown): a page's text, tables and images from the top down, under a mark with its number.

    blocks: doc_id, page, block_no, is_image, bbox, text; tables: doc_id, page, bbox, markdown, caption; images: doc_id, page, block_no, filename, caption,
    bbox. Tables that touch pseudo code are none; text that a table touches, or that lies in an image and is no caption, goes. One shuffle by
    page; what is gathered is one page.
    """
    none = lambda kind: F.lit(None).cast(kind)
    b = blocks.select(*PAGE, F.struct("block_no", "is_image", "bbox", X.strip(X.or_empty(F.col("text"))).alias("text")).alias("block"))
    t = tables.select(*PAGE, F.struct("bbox", F.when(X.or_empty(F.col("caption")) != "", F.concat(F.lit("**"), "caption", F.lit("**\n\n"), "markdown")).otherwise(F.col("markdown")).alias("markdown")).alias("table"))
    i = images.select(*PAGE, F.struct("block_no", F.coalesce(F.when(X.or_empty(F.col("caption")) != "", F.col("caption")), F.col("filename")).alias("alt"), "filename", "bbox").alias("image"))
    kinds = {"block": b.schema["block"].dataType, "table": t.schema["table"].dataType, "image": i.schema["image"].dataType}
    wide = [x.select(*PAGE, *[F.col(n) if n in x.columns else none(k).alias(n) for n, k in kinds.items()]) for x in (b, t, i)]
    page = reduce(DataFrame.unionByName, wide).groupBy(*PAGE).agg(*[F.array_sort(F.collect_list(n)).alias(f"{n}s") for n in kinds])

    texts = F.filter("blocks", lambda x: ~x["is_image"] & (x["text"] != ""))
    code = F.filter(texts, lambda x: S.algorithm_score(x["text"]) >= 5)
    pictures = F.concat(F.transform(F.filter("blocks", lambda x: x["is_image"]), lambda x: x["bbox"]), F.transform(F.filter("images", lambda x: x["bbox"].isNotNull()), lambda x: x["bbox"]))
    page = page.withColumn("texts", texts).withColumn("kept", X.let(code, lambda c: F.filter("tables", lambda y: ~F.exists(c, lambda x: intersects(x["bbox"], y["bbox"])))))
    page = page.withColumn("pictures", F.when(F.size("images") > 0, pictures).otherwise(F.slice(pictures, 1, 0)))

    def hidden(x: Column) -> Column:
        return F.exists("kept", lambda y: intersects(x["bbox"], y["bbox"])) | (~S.is_caption(x["text"]) & F.exists("pictures", lambda p: inside(x["bbox"], p)))

    def element(box: Column, kind: int, no: Column, markdown: Column) -> Column:
        return F.struct(box["y0"].alias("y"), F.lit(kind).alias("kind"), F.when(F.lit(kind) == 0, box["x0"]).otherwise(F.lit(0.0)).alias("x"), X.bigint(no).alias("no"), markdown.alias("markdown"))

    said = lambda x: F.when(S.algorithm_score(x["text"]) >= 5, x["text"]).otherwise(F.regexp_replace(x["text"], "\n+", " "))
    shown = lambda m: F.concat(F.lit("!["), m["alt"], F.lit("]("), m["filename"], F.lit(")"))
    image_of = lambda x: F.get(F.filter("images", lambda m: m["block_no"] == x["block_no"]), 0)
    placed = F.transform(F.filter("blocks", lambda x: x["is_image"] & image_of(x).isNotNull()), lambda x: element(x["bbox"], 0, x["block_no"], shown(image_of(x))))
    written = F.transform(F.filter("texts", lambda x: ~hidden(x)), lambda x: element(x["bbox"], 0, x["block_no"], said(x)))
    laid = F.transform("kept", lambda y, k: element(y["bbox"], 1, k, y["markdown"]))
    parts = F.transform(F.array_sort(F.concat(written, placed, laid)), lambda e: e["markdown"])
    mark = F.concat(F.lit("<!-- Page "), (F.col("page") + 1).cast("string"), F.lit(" -->\n\n"))
    return page.select(*PAGE, parts.alias("parts")).where("size(parts) > 0").select(*PAGE, F.concat(mark, F.array_join("parts", "\n\n")).alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown) of pages (doc_id, page, markdown), in order."""
    listed = F.array_sort(F.collect_list(F.struct("page", "markdown")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["markdown"]), "\n\n").alias("markdown"))


def has_placeholders(markdown: Column) -> Column:
    """Whether a formula is still missing."""
    return F.coalesce(markdown.rlike(r"<!--\s*formula-not-decoded\s*-->"), F.lit(False))


# A run of text around a LaTeX command, and a placeholder with the line after it.
COMMAND_RUN = r"(?<!\$)((?:[A-Za-z0-9_{}^]|\s)*+(?:(?<=[A-Za-z0-9_{}^\s])|)\\[a-zA-Z]+(?:[A-Za-z0-9_{}^()\s,.]|\\\w+)*)(?!\$)"
MISSING = r"<!--\s*formula-not-decoded\s*-->(\s*\n)([^\n]*)"


def wrapped(text: Column) -> Column:
    """Runs of text around LaTeX commands between dollar signs; a text with dollar signs stays."""
    runs = F.regexp_extract_all(text, F.lit(COMMAND_RUN), F.lit(1))
    shown = F.concat(F.transform(runs, lambda r: F.concat(F.lit("$"), X.strip(r), F.lit("$"))), F.array(F.lit("")))
    out = F.array_join(F.zip_with(F.split(text, COMMAND_RUN, -1), shown, lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("$") | ~text.contains("\\"), text).otherwise(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _commands(lines: pd.Series) -> pd.Series:
    return lines.map(lambda a: None if a is None else [L.latex_of(x) for x in a])


def salvaged(docs: DataFrame, markdown: str = "markdown", drop_rest: bool = False) -> DataFrame:
    """docs whose lines after a formula's placeholder have their symbols as LaTeX; with drop_rest the placeholders go, and blank lines beyond one."""
    m = F.col(markdown)
    lines, gaps = (F.regexp_extract_all(m, F.lit(MISSING), F.lit(k)) for k in (2, 1))
    rows = docs.withColumn("lines_", lines).withColumn("latex_", _commands("lines_"))
    text = F.zip_with("lines_", "latex_", lambda a, b: F.when(a == b, a).otherwise(wrapped(b)))
    kept = F.zip_with(gaps, text, lambda g, t: t if drop_rest else F.concat(F.lit(FORMULA_PLACEHOLDER), g, t))
    out = F.array_join(F.zip_with(F.split(m, MISSING, -1), F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    if drop_rest:
        out = F.regexp_replace(F.regexp_replace(out, r"<!--\s*formula-not-decoded\s*-->", ""), r"\n{3,}", "\n\n")
    return rows.withColumn(markdown, out).drop("lines_", "latex_")


def embedded(markdown: Column, assets: Column, most: int = 50, each: int = 2_000_000) -> Column:
    """struct<markdown, attempted, embedded, skipped_large, skipped_errors>: images as data URIs, from assets (array of struct<url, content, mime>).

    An image that wasn't fetched, or is too large, stays as it is; from `most` embedded images on all do. What is no image is attempted, no more. A fold over
    the references with three counters.
    """
    pattern = S.IMAGE.replace(".*?", "(.*?)")
    whole, alts, urls = (F.regexp_extract_all(markdown, F.lit(pattern), F.lit(k)) for k in (0, 1, 2))
    guessed = lambda u: F.regexp_extract(F.lower(u), r"\.(png|gif|webp|bmp|jpe?g|svg|tiff?)(?:[?#].*)?$", 1)

    def seen(r: Column) -> Column:
        found = F.get(F.filter(assets, lambda a: a["url"] == r["url"]), 0)
        ext = guessed(r["url"])
        guess = F.when(ext != "", F.concat(F.lit("image/"), F.when(ext == "jpg", "jpeg").when(ext == "svg", "svg+xml").when(ext == "tif", "tiff").otherwise(ext)))
        mime = F.when(X.or_empty(found["mime"]).startswith("image/"), found["mime"]).otherwise(guess)
        state = F.when(found["content"].isNull(), "error").when(mime.isNull(), "other").when(F.length(found["content"]) > each, "large").otherwise("image")
        uri = F.concat(F.lit("!["), r["alt"], F.lit("](data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(found["content"]), r"\s", ""), F.lit(")"))
        return F.struct(r["whole"].alias("whole"), state.alias("state"), uri.alias("uri"))

    def folded(refs: Column) -> Column:
        before = lambda i: X.sums_before(F.transform(refs, lambda r: (r["state"] == "image").cast("int")))
        return X.let(before(None), lambda sums: F.transform(refs, lambda r, i: F.struct(r["whole"].alias("whole"), F.when(F.get(sums, i) >= most, "left").otherwise(r["state"]).alias("state"), r["uri"].alias("uri"))))

    def shown(refs: Column) -> Column:
        count = lambda *s: X.bigint(F.size(F.filter(refs, lambda r: r["state"].isin(*s))))
        parts = F.concat(F.transform(refs, lambda r: F.when(r["state"] == "image", r["uri"]).otherwise(r["whole"])), F.array(F.lit("")))
        text = F.array_join(F.zip_with(F.split(markdown, pattern, -1), parts, lambda a, b: F.concat(a, b)), "")
        return F.struct(text.alias("markdown"), count("image", "large", "error", "other").alias("attempted"), count("image").alias("embedded"), count("large").alias("skipped_large"), count("error").alias("skipped_errors"))

    refs = F.transform(F.arrays_zip(whole.alias("whole"), alts.alias("alt"), urls.alias("url")), seen)
    return X.let(refs, lambda r: X.let(folded(r), shown))


def lost_images(html: Column, main: Column, least: int = 3) -> Column:
    """Why a page's main content can't be right: the page has images, and none is left."""
    count = lambda x: F.regexp_count(X.or_empty(x), F.lit(r"(?i)<img\b"))
    return F.when((count(html) >= least) & (count(main) == 0), F.concat(F.lit("all "), count(html).cast("string"), F.lit(" images were dropped")))


def graphics_as_images(html: Column) -> Column:
    """Elements <graphic> as <img>, with their attributes."""
    return F.regexp_replace(html, r"<(/?)graphic\b", "<$1img")


def gathered(results: dict[str, DataFrame], needed: str, names: tuple[str, ...]) -> DataFrame:
    """One row for each document of the needed stage, with the results of the named stages side by side, as structs; a stage that has none is null.

    results: stage to a DataFrame with one row for each doc_id.
    """
    if needed not in results:
        raise ValueError(f"no result of {needed}")
    packed = lambda df, n: df.select("doc_id", F.struct(*[c for c in df.columns if c != "doc_id"]).alias(n))
    out = packed(results[needed], needed)
    for name in names:
        out = out.join(packed(results[name], name), "doc_id", "left") if name in results else out.withColumn(name, F.lit(None).cast("string"))
    return out
