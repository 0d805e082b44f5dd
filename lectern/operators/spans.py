"""Spans of a line: math fonts, baselines, formulas out of runs of spans. And images among blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import latex as L
from ..functions import text as X
from .layout import script_type

# Families of fonts that set formulas.
MATH_FONTS = (
    r"CM(MI|SY|EX|R)\d*",
    r"(MSAM|MSBM)\d*",
    r"Euler",
    r"STIX.*Math",
    r"Symbol",
    r"Math(emat)?ica",
    r"Cambria\s*Math",
    r"Latin\s*Modern\s*Math",
    r"XITS\s*Math",
    r"Asana\s*Math",
    r"DejaVu.*Math",
    r"Fira\s*Math",
    r"Libertinus\s*Math",
    r"TeX\s*Gyre.*Math",
)

#: One span of a line.
SPAN = "struct<text:string,font:string,size:double,y:double>"


def is_math_font(name: Column) -> Column:
    return F.coalesce(name.rlike("(?i)" + "|".join(MATH_FONTS)), F.lit(False))


def normal_size(spans: Column) -> Column:
    """The most frequent size of spans with text; the smallest of equals."""
    sizes = F.transform(F.filter(spans, lambda s: X.strip(X.or_empty(s["text"])) != ""), lambda s: s["size"])

    def most(all_: Column) -> Column:
        counted = F.transform(F.array_distinct(all_), lambda v: F.struct((-F.size(F.filter(all_, lambda w: w == v))).alias("n"), v.alias("v")))
        return F.array_min(counted)["v"]

    return X.let(sizes, most)


def baseline(spans: Column) -> Column:
    """The upper median of the spans' heights."""
    ys = F.array_sort(F.transform(F.filter(spans, lambda s: X.strip(X.or_empty(s["text"])) != ""), lambda s: s["y"]))
    return X.let(ys, lambda y: F.get(y, F.floor(F.size(y) / 2).cast("int")))


def line_text(spans: Column, converted: Column) -> Column:
    """A line with its runs of math spans as $...$; converted holds the spans' texts with symbols as commands.

    A fold over the spans: text so far, and the run that is open.
    """
    line = F.struct(normal_size(spans).alias("size"), baseline(spans).alias("y"))

    def folded(of: Column) -> Column:
        items = F.zip_with(spans, converted, lambda s, c: F.struct(s["text"].alias("text"), c.alias("latex"), script_type(s["size"], s["y"], of["y"], of["size"]).alias("script"), (is_math_font(s["font"]) | L.has_symbols(s["text"])).alias("math")))
        close = lambda st: F.when(X.strip(st["run"]) != "", F.concat(st["out"], F.lit("$"), X.strip(st["run"]), F.lit("$"))).otherwise(st["out"])

        def step(st: Column, s: Column) -> Column:
            marked = F.when(s["script"] == "superscript", F.concat(F.lit("^{"), s["latex"], F.lit("}"))).when(s["script"] == "subscript", F.concat(F.lit("_{"), s["latex"], F.lit("}"))).otherwise(s["latex"])
            math = s["math"] | (s["script"] != "normal")
            return F.when(X.or_empty(s["text"]) == "", st).when(math, F.struct(st["out"].alias("out"), F.concat(st["run"], marked).alias("run"))).otherwise(F.struct(F.concat(close(st), s["text"]).alias("out"), F.lit("").alias("run")))

        return F.aggregate(items, F.struct(F.lit("").alias("out"), F.lit("").alias("run")), step, close)

    return X.let(line, lambda of: F.when(of["size"].isNull(), F.lit("")).otherwise(folded(of)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def converted(texts: pd.Series) -> pd.Series:
    """Each text of an array with symbols as commands."""
    return texts.map(lambda a: None if a is None else [L.latex_of(t) for t in a])


def lines_with_formulas(lines: DataFrame, spans: str = "spans") -> DataFrame:
    """lines with `text`, rebuilt from their spans (array of SPAN)."""
    latex = converted(F.transform(spans, lambda s: s["text"]))
    return lines.withColumn("latex", latex).withColumn("text", line_text(F.col(spans), F.col("latex"))).drop("latex")


def rewrite_references(markdown: Column, names: Column, folder: str = "images") -> Column:
    """Image references whose file is one of names point into the folder; data URIs and what is there already stay."""
    pattern = r"!\[([^\]]*)\]\(([^)]+)\)"
    whole, alts, paths = (F.regexp_extract_all(markdown, F.lit(pattern), F.lit(k)) for k in (0, 1, 2))

    def one(ref: Column) -> Column:
        path = ref["path"]
        name = F.regexp_extract(path, r"([^/]*)$", 1)
        kept = path.startswith("data:") | path.startswith(f"{folder}/") | ~F.coalesce(F.array_contains(names, name), F.lit(False))
        return F.when(kept, ref["whole"]).otherwise(F.concat(F.lit("!["), ref["alt"], F.lit(f"]({folder}/"), name, F.lit(")")))

    refs = F.concat(F.transform(F.arrays_zip(whole.alias("whole"), alts.alias("alt"), paths.alias("path")), one), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(markdown, pattern, -1), refs, lambda a, b: F.concat(a, b)), "")


def with_unplaced_images(markdown: Column, images: Column) -> Column:
    """markdown and, under a heading, the images (struct<filename, caption>) that it doesn't name."""
    left = F.filter(images, lambda i: ~markdown.contains(i["filename"]))
    shown = F.transform(left, lambda i: F.concat(F.lit("!["), F.coalesce(i["caption"], i["filename"]), F.lit("]("), i["filename"], F.lit(")")))
    return F.when(F.size(left) > 0, F.concat(markdown, F.lit("\n\n## Extracted Images\n\n"), F.array_join(shown, "\n\n"))).otherwise(markdown)


def matched_images(blocks: Column, images: Column, margin: float = 20.0) -> Column:
    """For each image block in turn the place of its image, or null: an unused one with the largest common area, else one whose centre lies within the margin.

    Boxes are struct<x0,y0,x1,y1>. A fold with the set of used places: what one block takes, later ones can't.
    """
    from .layout import overlap

    def centre_near(b: Column, i: Column) -> Column:
        x, y = (i["x0"] + i["x1"]) / 2, (i["y0"] + i["y1"]) / 2
        return x.between(b["x0"] - margin, b["x1"] + margin) & y.between(b["y0"] - margin, b["y1"] + margin)

    def step(taken: Column, block: Column) -> Column:
        free = F.filter(F.transform(images, lambda i, k: F.struct((-overlap(block, i)).alias("area"), k.alias("k"), centre_near(block, i).alias("near"))), lambda c: ~F.array_contains(taken, c["k"]))
        best = F.array_min(F.filter(free, lambda c: c["area"] < 0))["k"]
        near = F.array_min(F.transform(F.filter(free, lambda c: c["near"]), lambda c: c["k"]))
        return F.concat(taken, F.array(F.coalesce(best, near, F.lit(-1))))

    found = F.aggregate(blocks, F.array().cast("array<int>"), step)
    return F.transform(found, lambda k: F.when(k >= 0, k))
