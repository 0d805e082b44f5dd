"""Pages to links, metadata, elements and Markdown. One parse of each page, in Arrow batches; what comes out are columns and
element arrays, and everything after that is DataFrame work. Rows are independent: no shuffle, and the same code runs on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources import dom

#: What a parse can give, and its type. main_tag is the element that the content is taken from, place_tag the first place of content, however little
#: it holds (a page without any element for it is all body).
PARTS = {
    "title": "string",
    "description": "string",
    "links": "array<struct<url:string,text:string>>",
    "page_images": "array<struct<src:string,alt:string,title:string,width:int,height:int>>",
    "page_text": "string",
    "main_tag": "string",
    "place_tag": "string",
    "main_html": "string",
    "cleaned_html": "string",
    "markdown": "string",
    "plain_markdown": "string",
    "tables": "array<struct<markdown:string,rows:int,columns:int,headers:array<string>,caption:string,cells:array<array<string>>>>",
    "images": "array<struct<src:string,alt:string,title:string,width:int,height:int>>",
    "code_blocks": "array<struct<code:string,language:string>>",
    "formulas": "array<struct<latex:string,formula_type:string,source_format:string>>",
    "fields": "map<string,array<string>>",
    "error": "string",
}


def _page(html: str | None, base: str | None, want: tuple[str, ...], config: dict | None, closed: bool = False) -> dict:
    """The wanted parts; an error is a value, not an exception."""
    out: dict = dict.fromkeys(want)
    html = dom.closed_references(html or "") if closed else html
    try:
        root = dom.parse(html)
        make = {
            "title": lambda: dom.title(root),
            "description": lambda: dom.description(root),
            "links": lambda: dom.links(root, base),
            "page_images": lambda: dom.images(root, base),
            "page_text": lambda: root.text(),
            "main_tag": lambda: dom.main_content(root).tag,
            "place_tag": lambda: dom.main_content(root, 0).tag or "body",
            "main_html": lambda: dom.main_content(root).html(),
            "code_blocks": lambda: dom.code_blocks(root),
            "formulas": lambda: dom.formulas(root),
            "fields": lambda: dom.extract(root, config or {}),
            "plain_markdown": lambda: dom.plain_markdown(html),
        }
        out |= {k: make[k]() for k in want if k in make}
        if {"cleaned_html", "markdown", "tables", "images"} & set(want):
            clean = dom.sanitize(dom.main_content(root).html(), base)
            made = {"cleaned_html": clean.html, "markdown": lambda: dom.markdown(clean), "tables": lambda: dom.tables(clean), "images": lambda: dom.images(clean, base)}
            out |= {k: f() for k, f in made.items() if k in want}
    except Exception as e:  # noqa: BLE001 - one bad page must not end the job; it has its error in its row, and its text as it is
        out["error"] = f"{type(e).__name__}: {e}"
        if "markdown" in want:
            out["markdown"] = dom.plain_markdown(html)
    return out


def perceive(pages: DataFrame, *want: str, html: str = "html", url: str = "url", config: dict | None = None, closed: bool = False) -> DataFrame:
    """pages without the html, with the wanted parts; a column of that name is replaced. Only what is asked for is made.

    With `closed` only character references that end in a semicolon are read.
    """
    unknown = set(want) - set(PARTS)
    if unknown:
        raise ValueError(f"no such part: {sorted(unknown)}")
    rest = [f for f in pages.schema.fields if f.name != html and f.name not in want]
    schema = T.StructType([*rest, *(T.StructField(w, T._parse_datatype_string(PARTS[w])) for w in want)])
    keep = [f.name for f in rest]
    read = list(dict.fromkeys([*keep, html, *([url] if url in pages.columns else [])]))
    types = to_arrow_schema(T.StructType(schema.fields[len(rest) :])).types
    rules = dom.normalize_config(config) if config else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            # other columns pass as they are: as a frame, one null would make floating-point numbers of the integers beside it
            of = lambda name, x=x: x.column(read.index(name))
            bases = of(url).to_pylist() if url in read else [None] * len(x)
            found = [_page(h, b, want, rules, closed) for h, b in zip(of(html).to_pylist(), bases, strict=True)]
            made = [pa.array([list(v.items()) if isinstance(v := f.get(w), dict) else v for f in found], t) for w, t in zip(want, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(of, keep), *made], names=[*keep, *want])

    return pages.select(*read).mapInArrow(run, schema)


def discover_links(pages: DataFrame, filter_domains: list[str] | None = None, exclude_domains: list[str] | None = None, internal_only: bool = False) -> DataFrame:
    """page_id, pos, url, text, is_internal of every link, in document order; empty lists filter nothing."""
    rows = perceive(pages.select("page_id", "url", "html"), "links").withColumnRenamed("url", "page_url").select("page_id", "page_url", F.posexplode("links").alias("pos", "link"))
    rows = rows.select("page_id", X.bigint(F.col("pos")).alias("pos"), F.col("link.url").alias("url"), X.strip(F.col("link.text")).alias("text"), X.domain(F.col("link.url")).alias("domain"), X.domain(F.col("page_url")).alias("own"))
    rows = rows.withColumn("is_internal", F.col("domain") == F.col("own")).where("url <> ''")
    if internal_only:
        rows = rows.where("is_internal")
    if filter_domains:
        rows = rows.where(F.col("domain").isin(filter_domains))
    if exclude_domains:
        rows = rows.where(~F.col("domain").isin(exclude_domains))
    return rows.select("page_id", "pos", "url", "text", "is_internal")


def link_summary(pages: DataFrame) -> DataFrame:
    """Counts for each page; a page without links counts none."""
    found = perceive(pages.select("page_id", "url", "html"), "links")
    own = X.domain(F.col("url"))
    inside = F.size(F.filter("links", lambda x: X.domain(x["url"]) == own))
    return found.select("page_id", X.bigint(F.size("links")).alias("total_links"), X.bigint(inside).alias("internal_links_count"), X.bigint(F.size("links") - inside).alias("external_links_count"))


def inspect_pages(pages: DataFrame, closed: bool = False) -> DataFrame:
    """page_id, url, title, description; `closed` as in `perceive`."""
    return perceive(pages.select("page_id", "url", "html"), "title", "description", closed=closed).select("page_id", "url", "title", "description")


def audit(pages: DataFrame, most: int = 3) -> DataFrame:
    """For each page its first internal links, and whether the table has a page for them. The look-up is a left join on the URL."""
    links = discover_links(pages, internal_only=True)
    first = links.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("place") <= most)
    known = pages.select(F.col("url").alias("known")).distinct()
    return first.join(known, first["url"] == known["known"], "left").groupBy("page_id").agg(F.count("*").alias("checked"), F.count_if(F.col("known").isNull()).alias("broken"))


def batch_summary(pages: DataFrame) -> DataFrame:
    """One row: pages, successes, failures, words, share of successes."""
    ok = (X.strip(F.col("markdown")) != "") & X.is_valid_url(F.col("url"))
    found = perceive(pages.select("page_id", "url", "html"), "markdown")
    return found.agg(F.count("*").alias("total_urls"), F.count_if(ok).alias("successful_count"), F.count_if(~ok).alias("failed_count"), F.coalesce(F.sum(X.word_count(F.col("markdown"))), F.lit(0)).alias("total_word_count"), (F.count_if(ok) / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"))


def site_report(pages: DataFrame) -> DataFrame:
    """For each site its pages, links and words."""
    found = perceive(pages.select("page_id", "url", "html"), "links", "title", "page_text")
    return found.groupBy(X.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.sum(X.bigint(F.size("links"))).alias("links"), F.sum(X.word_count(F.col("page_text"))).alias("words"), F.count_if(F.col("title") != "").alias("titled"))


def source_html(cleaned, main, raw):
    """The best HTML at hand: cleaned, else the main content, else the page."""
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(cleaned), full(main), raw, F.lit(""))
