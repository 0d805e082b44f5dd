"""Geometry, captions, reading order and assembly, over boxes made from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as L
from . import Registry, table

R = Registry()

_BLOCKS = {
    "doc_id": "l_orderkey",
    "page": "l_linenumber % 2",
    "block_no": "l_linenumber * 100000 + l_partkey",
    "x0": "l_partkey % 300",
    "y0": "l_suppkey * 13 % 600",
    "x1": "l_partkey % 300 + 40 + l_quantity * 3",
    "y1": "l_suppkey * 13 % 600 + 12 + l_linenumber",
    "text": "concat(case when l_partkey % 3 = 0 then 'Figure ' when l_partkey % 3 = 1 then ' Table ' else 'note ' end, cast(l_partkey as string), chr(10), 'about ', l_returnflag)",
    "flag": "l_returnflag",
    "size": "8 + l_quantity / 5",
}
_FIGURES = {"doc_id": "l_orderkey", "page": "l_linenumber % 2", "target_no": "l_linenumber * 100000 + l_partkey", "x0": "l_suppkey * 3 % 200", "y0": "l_partkey % 500", "x1": "l_suppkey * 3 % 200 + 260", "y1": "l_partkey % 500 + 150"}


def _sql(columns: dict[str, str], where: str) -> str:
    return "select " + ", ".join(f"cast({v} as double) as {k}" if k in ("x0", "y0", "x1", "y1", "size") else f"{v} as {k}" for k, v in columns.items()) + f" from lineitem where {where}"


def _with(columns: dict[str, str], where: str, spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(where).select(*[F.expr(v).alias(k) for k, v in columns.items()])
    return rows.withColumn("bbox", L.box("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


_B, _F = _sql(_BLOCKS, "l_returnflag <> 'R'"), _sql(_FIGURES, "l_returnflag = 'R'")


def blocks(spark, sf_dir):
    return _with(_BLOCKS, "l_returnflag <> 'R'", spark, sf_dir)


def figures(spark, sf_dir):
    return _with(_FIGURES, "l_returnflag = 'R'", spark, sf_dir)


_HIT = "greatest(least(b.x1, f.x1) - greatest(b.x0, f.x0), 0) * greatest(least(b.y1, f.y1) - greatest(b.y0, f.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.6"
_IS_CAPTION = "(text like 'Figure %' or text like ' Table %')"


@R.add("figure_texts", f"with b as ({_B}), f as ({_F}) select distinct b.doc_id, b.page, trim(b.text) as text from b join f on b.doc_id = f.doc_id and b.page = f.page and {_HIT} where not {_IS_CAPTION}")
def figure_texts(spark, sf_dir):
    return L.figure_texts(blocks(spark, sf_dir), figures(spark, sf_dir))


@R.add("texts_removed", f"with b as ({_B}), f as ({_F}), t as (select distinct b.doc_id, b.text from b join f on b.doc_id = f.doc_id and b.page = f.page and {_HIT} where not {_IS_CAPTION}) select b.doc_id, coalesce(string_agg(case when t.text is null then b.text end, chr(10) || chr(10) order by block_no), '') as markdown from b left join t on b.doc_id = t.doc_id and trim(b.text) = trim(t.text) group by b.doc_id")
def texts_removed(spark, sf_dir):
    """Blocks of one number stand as in the table, by file and row: the SQL leaves their order open."""
    rows = _with(_BLOCKS | {"file": "_metadata.file_path", "row": "_metadata.row_index"}, "l_returnflag <> 'R'", spark, sf_dir)
    whole = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "file", "row", "text"))), lambda b: b["text"]), "\n\n").alias("markdown"))
    return L.without_texts(whole, L.figure_texts(rows, figures(spark, sf_dir)).select("doc_id", "text"))


def _caption_sql(above: bool) -> str:
    gap = lambda d: f"case when {d} >= -5 then {d} else 31 end"
    below = gap("b.y0 - f.y1")
    distance = f"least({below}, {gap('f.y0 - b.y1')})" if above else below
    return (
        f"with b as ({_B}), f as ({_F}), c as (select f.doc_id, f.page, f.target_no, substr(replace(trim(b.text), chr(10), ' '), 1, 120) as caption, row_number() over (partition by f.doc_id, f.page, f.target_no order by {distance}, b.block_no) as k "
        f"from f join b on b.doc_id = f.doc_id and b.page = f.page and least(b.x1, f.x1) - greatest(b.x0, f.x0) > 0 and {distance} <= 30 where {_IS_CAPTION}) select f.doc_id, f.page, f.target_no, c.caption from f left join c on c.k = 1 and f.doc_id = c.doc_id and f.page = c.page and f.target_no = c.target_no"
    )


@R.add("table_captions", _caption_sql(True))
def table_captions(spark, sf_dir):
    return L.captions(figures(spark, sf_dir), blocks(spark, sf_dir)).select("doc_id", "page", "target_no", "caption")


@R.add("image_captions", _caption_sql(False))
def image_captions(spark, sf_dir):
    return L.captions(figures(spark, sf_dir), blocks(spark, sf_dir), above=False).select("doc_id", "page", "target_no", "caption")


@R.add("uncovered_blocks", f"with b as ({_B}), f as ({_F}) select doc_id, page, block_no from b where not exists (select 1 from f where f.doc_id = b.doc_id and f.page = b.page and f.target_no % 2 = 0 and least(b.x1, f.x1) > greatest(b.x0, f.x0) and least(b.y1, f.y1) > greatest(b.y0, f.y0)) and not exists (select 1 from f where f.doc_id = b.doc_id and f.page = b.page and f.target_no % 2 = 1 and {_HIT})")
def uncovered_blocks(spark, sf_dir):
    f = figures(spark, sf_dir)
    return L.uncovered(blocks(spark, sf_dir), f.where("target_no % 2 = 0"), f.where("target_no % 2 = 1")).select("doc_id", "page", "block_no")


@R.add("reading_order", f"with b as ({_B}) select doc_id, page, block_no, row_number() over (partition by doc_id order by page, y0, x0, block_no) - 1 as reading_order from b")
def reading_order(spark, sf_dir):
    return L.reading_order(blocks(spark, sf_dir)).select("doc_id", "page", "block_no", "reading_order")


@R.add("title_regions", f"with b as ({_B}) select doc_id, page, block_no, y1 + 2 as top, coalesce(lead(y0) over (partition by doc_id, page order by y0, block_no) - 5, 802.0)::double as bottom from b where {_IS_CAPTION}")
def title_regions(spark, sf_dir):
    rows = blocks(spark, sf_dir).where("text like 'Figure %' or text like ' Table %'")
    return L.title_regions(rows).select("doc_id", "page", "block_no", "top", "bottom")


@R.add("region_kinds", f"with b as ({_B}) select case when block_no % 7 = 0 then 'figure' when size > 14 then 'header' else 'text' end as region_type, count(*) as n, min(case when block_no % 7 = 0 then 0 else 600 end)::bigint as weight from b group by 1")
def region_kinds(spark, sf_dir):
    kind = L.region_kind(F.col("block_no") % 7 == 0, F.col("size"))
    return blocks(spark, sf_dir).groupBy(kind.alias("region_type")).agg(F.count("*").alias("n"), X.bigint(F.min(F.when(F.col("block_no") % 7 == 0, 0).otherwise(600))).alias("weight"))


_LABEL = "case l_linenumber % 5 when 0 then 'title' when 1 then 'section_header' when 2 then 'list_item' when 3 then 'footnote' else 'text' end"


@R.add("block_types", f"select l_orderkey, l_linenumber, case {_LABEL} when 'title' then 'heading' when 'section_header' then 'heading' when 'list_item' then 'list_item' when 'footnote' then 'footnote' else 'paragraph' end as block_type, case {_LABEL} when 'title' then 1 when 'section_header' then 2 end as heading_level from lineitem")
def block_types(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LABEL).alias("label")).select("l_orderkey", "l_linenumber", L.block_type(F.col("label"))["block_type"].alias("block_type"), L.block_type(F.col("label"))["heading_level"].alias("heading_level"))


@R.add("script_types", "with m as (select l_orderkey, l_linenumber, 4 + l_quantity / 5 as size, l_suppkey % 13 - 6.0 as d from lineitem) select l_orderkey, l_linenumber, case when size / 10 >= 0.75 then 'normal' when d < -2 then 'superscript' when d > 2 then 'subscript' when size / 10 < 0.65 then 'superscript' else 'normal' end as script from m")
def script_types(spark, sf_dir):
    size, d = 4 + F.col("l_quantity") / 5, F.col("l_suppkey") % 13 - 6.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.script_type(size, d + 100, F.lit(100.0), F.lit(10.0)).alias("script"))


@R.add("block_formulas", f"with b as ({_B}) select doc_id, block_no, abs((x0 + x1) / 2 - 300) < 90 and flag = 'A' as is_block, case when block_no % 2 = 0 then cast(block_no as varchar) || '.' || cast(page as varchar) end as equation from b")
def block_formulas(spark, sf_dir):
    rows = blocks(spark, sf_dir)
    line = F.when(F.col("block_no") % 2 == 0, F.concat(F.lit("x = y ("), F.col("block_no").cast("string"), F.lit("."), F.col("page").cast("string"), F.lit(")  "))).otherwise("f(2) = z")
    return rows.select("doc_id", "block_no", L.is_block_formula(F.col("bbox"), F.lit(600.0), F.col("flag") == "A").alias("is_block"), L.equation_number(line).alias("equation"))


@R.add("boxes_from_bottom", f"with b as ({_B}) select doc_id, block_no, case when page = 0 then 842 - y0 else y0 end as y0, case when page = 0 then 842 - y1 else y1 end as y1, greatest(0, block_no - 1) as page_no from b")
def boxes_from_bottom(spark, sf_dir):
    turned = L.top_left(F.col("bbox"), F.lit(842.0), F.when(F.col("page") == 0, "BOTTOMLEFT").otherwise("TOPLEFT"))
    return blocks(spark, sf_dir).select("doc_id", "block_no", turned["y0"].alias("y0"), turned["y1"].alias("y1"), X.bigint(L.zero_based(F.col("block_no").cast("string"))).alias("page_no"))


_ELEMENTS = "select doc_id, page, case when block_no % 4 = 0 then null else y0 end as y0, x0, block_no, case block_no % 5 when 0 then 0 when 1 then 0 when 2 then 2 when 3 then 3 else 4 end as kind_no, case block_no % 5 when 0 then '## ' || trim(text) when 1 then '- ' || trim(text) when 2 then '$$' || chr(10) || trim(text) || chr(10) || '$$' when 3 then '```' || flag || chr(10) || trim(text) || chr(10) || '```' else '![' || flag || '](' || trim(text) || ')' end as md from b"


@R.add("assembled_markdown", f"with b as ({_B}), e as ({_ELEMENTS}) select doc_id, string_agg(md, chr(10) || chr(10) order by page, coalesce(y0, block_no * 100.0), case when y0 is null then 0.0 else x0 end, block_no, kind_no) as markdown from e group by doc_id")
def assembled_markdown(spark, sf_dir):
    k = F.col("block_no") % 5
    kind = F.when(k == 0, "heading").when(k == 1, "list_item").when(k == 2, "formula").when(k == 3, "code").otherwise("image")
    place = F.when(k <= 1, 0).otherwise(k)
    rows = blocks(spark, sf_dir)
    made = rows.select("doc_id", "page", F.when(F.col("block_no") % 4 != 0, F.col("bbox")).alias("bbox"), F.col("block_no").alias("reading_order"), place.alias("kind_no"), F.lit(0).alias("pos"), L.render(kind, X.strip(F.col("text")), F.lit(2), F.col("flag")).alias("markdown"))
    return L.assemble(made)
