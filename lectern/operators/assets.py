"""Assets of documents: budgets, placeholders, references, summaries, harvests from Markdown, engine output in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Placeholders, and what fences, tables and formulas of engines' Markdown look like.
PLACEHOLDER = "<!-- image -->"
FORMULA_PLACEHOLDER = "<!-- formula-not-decoded -->"
CODE_FENCE = r"```(\w*)\n([\s\S]*?)```"
PIPE_TABLE = r"(?m)^(\|[^\n]+\|\n\|[-| :]+\|\n(?:\|[^\n]+\|(?:\n|$))*)"
BLOCK_FORMULA, INLINE_FORMULA = r"\$\$([\s\S]+?)\$\$", r"(?<!\$)\$(?!\$)([^$\n]+?)\$(?!\$)"
FORMULAS_IN_TEXT = ((r"\\\[\s*([^]]+?)\s*\\\]", "block"), (r"\$\$\s*([^$]+?)\s*\$\$", "block"), (r"\\\(\s*([^)]+?)\s*\\\)", "inline"), (r"(?<!\$)\$([^$]+?)\$(?!\$)", "inline"))


def within_budget(items: Column, size, each: int, total: int) -> Column:
    """The items that fit: none over `each`, and in order while the sum stays within `total`; one that doesn't fit is passed over."""
    kept = F.slice(items, 1, 0)
    start = F.struct(F.lit(0).cast("bigint").alias("used"), kept.alias("kept"))

    def step(state: Column, item: Column) -> Column:
        fits = (size(item) <= each) & (state["used"] + size(item) <= total)
        return F.struct(F.when(fits, state["used"] + size(item)).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["kept"], F.array(item))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(items, start, step, lambda s: s["kept"])


def image_bytes(base64: Column, content: Column) -> Column:
    return F.coalesce(F.try_to_binary(base64, F.lit("base64")), content)


def place_images(markdown: Column, names: Column, captions: Column, folder: str = "images") -> Column:
    """The nth placeholder becomes the nth image that has a file name; placeholders without one stay."""
    named = F.filter(F.arrays_zip(names.alias("name"), captions.alias("caption")), lambda i: F.coalesce(i["name"], F.lit("")) != "")
    refs = F.transform(named, lambda i: F.concat(F.lit("!["), F.coalesce(i["caption"], F.lit("")), F.lit(f"]({folder}/"), i["name"], F.lit(")")))
    return _placed(markdown, PLACEHOLDER, refs)


def place_formulas(markdown: Column, formulas: Column, drop_rest: bool = False) -> Column:
    """The nth placeholder becomes the nth block formula (struct<latex, formula_type, equation_number>), with its number."""
    blocks = F.filter(formulas, lambda f: f["formula_type"] == "block")
    shown = F.transform(blocks, lambda f: F.concat(F.lit("$$\n"), f["latex"], F.lit("\n$$"), F.coalesce(F.concat(F.lit(" ("), f["equation_number"], F.lit(")")), F.lit(""))))
    return _placed(markdown, FORMULA_PLACEHOLDER, shown, "" if drop_rest else FORMULA_PLACEHOLDER)


def _placed(text: Column, mark: str, values: Column, rest: str | None = None) -> Column:
    parts = F.split(text, f"\\Q{mark}\\E", -1)
    filled = lambda p: F.transform(p, lambda s, i: F.when(i < F.size(p) - 1, F.concat(s, F.coalesce(F.get(values, i), F.lit(mark if rest is None else rest)))).otherwise(s))
    return X.let(parts, lambda p: F.array_join(filled(p), ""))


def asset_summary(elements: DataFrame) -> DataFrame:
    """Counts by document of elements (doc_id, kind, language, rows, columns, formula_type, size)."""
    k = lambda name: F.col("kind") == name
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    return elements.groupBy("doc_id").agg(
        F.count_if(k("image")).alias("images"),
        F.count_if(k("table")).alias("tables"),
        F.count_if(k("formula")).alias("formulas"),
        F.count_if(k("code")).alias("code_blocks"),
        F.count_if(k("formula") & (F.col("formula_type") == "block")).alias("block_formulas"),
        F.count_if(k("formula") & (F.col("formula_type") == "inline")).alias("inline_formulas"),
        total("rows", k("table")).alias("table_rows"),
        total("columns", k("table")).alias("table_columns"),
        total("size", k("image")).alias("image_bytes"),
        F.array_join(F.array_sort(F.collect_set(F.when(k("code"), F.col("language")))), ",").alias("languages"),
    )


def code_harvest(markdown: Column) -> Column:
    """array<struct<language, code>> of the fences."""
    pattern = F.lit(CODE_FENCE)
    return F.zip_with(F.regexp_extract_all(markdown, pattern, F.lit(1)), F.regexp_extract_all(markdown, pattern, F.lit(2)), lambda a, b: F.struct(F.nullif(a, F.lit("")).alias("language"), X.strip(b).alias("code")))


def table_harvest(markdown: Column) -> Column:
    """array<struct<markdown, rows, columns>> of the pipe tables; rows without header and rule."""
    found = F.regexp_extract_all(markdown, F.lit(PIPE_TABLE), F.lit(1))

    def shape(t: Column) -> Column:
        rows = F.split(X.strip(t), "\n")
        first = F.get(rows, 0)
        return F.struct(X.strip(t).alias("markdown"), X.bigint(F.size(rows) - 2).alias("rows"), X.bigint(F.length(first) - F.length(F.replace(first, F.lit("|"), F.lit(""))) - 1).alias("columns"))

    return F.transform(found, shape)


def formula_harvest(markdown: Column) -> Column:
    """array<struct<latex, formula_type>>: blocks, then inline ones longer than a character."""
    of = lambda p, kind: F.transform(F.regexp_extract_all(markdown, F.lit(p), F.lit(1)), lambda x: F.struct(X.strip(x).alias("latex"), F.lit(kind).alias("formula_type")))
    return F.concat(of(BLOCK_FORMULA, "block"), F.filter(of(INLINE_FORMULA, "inline"), lambda f: F.length(f["latex"]) > 1))


def formulas_in_text(text: Column) -> Column:
    """array<struct<latex, formula_type>> by delimiter: \\[ \\], $$, \\( \\), $; overlaps stay, single characters don't count."""
    of = lambda p, kind: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.struct(X.strip(x).alias("latex"), F.lit(kind).alias("formula_type")))
    return F.filter(F.concat(*[of(p, k) for p, k in FORMULAS_IN_TEXT]), lambda f: F.length(f["latex"]) > 1)


#: One item of an engine's content list.
ITEM = "struct<type:string,text:string,text_level:int,table_body:string,latex:string,img_path:string,caption:string,page_idx:int>"


def content_list(json: Column) -> Column:
    return F.from_json(json, f"array<{ITEM}>")


def content_markdown(items: Column) -> Column:
    """A content list as Markdown: texts, tables, equations, images, in order; unknown types are left out."""

    def one(i: Column) -> Column:
        return (
            F.when((i["type"] == "text") & (i["text_level"] > 0), F.concat(F.repeat(F.lit("#"), i["text_level"]), F.lit(" "), i["text"]))
            .when(i["type"] == "text", i["text"])
            .when(i["type"] == "table", i["table_body"])
            .when(i["type"] == "equation", F.concat(F.lit("$$\n"), i["latex"], F.lit("\n$$")))
            .when(i["type"] == "image", F.concat(F.lit("!["), F.coalesce(i["caption"], F.lit("")), F.lit("]("), i["img_path"], F.lit(")")))
        )

    return F.array_join(F.filter(F.transform(items, one), lambda s: X.strip(F.coalesce(s, F.lit(""))) != ""), "\n\n")


def parse_response(text: Column) -> Column:
    """struct<value, error>: the JSON of a response, out of one code fence if it stands in one; what can't be parsed is an error."""
    inner = F.regexp_replace(X.strip(X.or_empty(text)), r"(?s)^```[a-z]*\s*\n?(.*?)\n?```$", "$1")
    value = F.try_parse_json(inner)
    return F.struct(F.to_json(value).alias("value"), F.when(value.isNull(), F.lit("not JSON")).alias("error"))


def html_table_shape(html: Column) -> Column:
    """struct<rows, columns> of an HTML table, by counting its tags."""
    rows = F.regexp_count(html, F.lit("(?i)<tr[ >]"))
    cells = F.regexp_count(html, F.lit("(?i)<t[dh][ >]"))
    return F.struct(X.bigint(rows).alias("rows"), X.bigint(F.when(rows > 0, F.floor(cells / rows)).otherwise(0)).alias("columns"))
