"""What engines return, made from the tables, in one form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import engines as E
from . import Registry, table

R = Registry()


@R.add("engine_boxes", "select p_partkey, case when p_partkey % 5 <> 1 then p_size when p_partkey % 3 <> 0 then p_size + 10 end::double as x0, case when p_partkey % 5 <> 1 then p_size + 3 when p_partkey % 3 <> 0 then p_size + 13 end::double as y1 from part")
def engine_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    first = [F.when(F.lit(n != "t") | (k % 5 != 1), F.col("p_size") + i).alias(n) for i, n in enumerate("ltrb")]
    second = [F.when(F.lit(n != "y1") | (k % 3 != 0), F.col("p_size") + 10 + i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = table(spark, sf_dir, "part").select("p_partkey", E.box_of(F.struct(*first, *second)).alias("b"))
    return rows.select("p_partkey", "b.x0", "b.y1")


@R.add(
    "item_boxes",
    "with m as (select p_partkey, p_size as s, p_partkey % 8 as k from part) select p_partkey, case k when 0 then s when 1 then s when 2 then s + 0.5 when 3 then 0 end::double as x0, case k when 0 then 4 when 1 then 4 when 2 then 0 when 3 then 7 end::double as y1 from m",
)
def item_boxes(spark, sf_dir):
    k, s = F.col("p_partkey") % 8, F.col("p_size").cast("string")
    item = (
        F.when(k == 0, F.concat(F.lit('{"bbox": ['), s, F.lit(", 2, 3, 4, 9]}")))
        .when(k == 1, F.concat(F.lit('{"type": "t", "bbox": {"x0": '), s, F.lit(', "top": 2, "x1": 3, "bottom": 4}}')))
        .when(k == 2, F.concat(F.lit('{"bbox": {"left": '), s, F.lit(".5}}")))
        .when(k == 3, F.lit('{"bbox": {"y1": 7}}'))
        .when(k == 4, F.lit('{"bbox": [1, 2, 3]}'))
        .when(k == 5, F.lit('{"bbox": [1, 2, "x", 4]}'))
        .when(k == 6, F.lit('{"text": "none"}'))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", E.box_of_json(item).alias("b"))
    return rows.select("p_partkey", "b.x0", "b.y1")


_PARAGRAPHS = "concat('# ', o_orderpriority, chr(10), 'more', chr(10), chr(10), ' plain ', cast(o_custkey as string), chr(10), chr(10), chr(10), '- item', chr(10), chr(10), '### 2. both', chr(10), chr(10), '#no heading', chr(10), chr(10), '  ')"


@R.add(
    "paragraph_blocks",
    "select o_orderkey, unnest(['' || o_orderpriority, 'plain ' || o_custkey, '- item', '2. both', '#no heading']) as text, unnest(['heading', 'paragraph', 'list_item', 'list_item', 'paragraph']) as block_type, unnest([1, null, null, 3, null])::int as heading_level, unnest([0, 1, 2, 3, 4])::bigint as reading_order from orders",
)
def paragraph_blocks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(E.paragraph_blocks(F.expr(_PARAGRAPHS))))


@R.add("page_blocks", "select conv_id as doc_id, turn as page, trim(text, ' ' || chr(10) || chr(9)) as text, 'paragraph' as block_type, row_number() over (partition by conv_id order by turn)::bigint - 1 as reading_order from conversations where trim(coalesce(text, ''), ' ' || chr(10) || chr(9)) <> '' and turn % 3 <> 1")
def page_blocks(spark, sf_dir):
    text = F.when(F.col("turn") % 3 != 1, F.concat(F.lit(" \n"), "text", F.lit("\t "))).otherwise(F.when(F.col("turn") % 2 == 0, F.lit(" \n ")))
    return E.page_blocks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), text.alias("text")))


@R.add("engine_tables", "select 'tbl_' || (row_number() over (partition by o_custkey order by o_orderkey) - 1) as id, o_custkey as doc_id, case when o_orderkey % 2 = 0 then o_orderkey % 9 else 0 end::int as page, '| ' || o_orderstatus || ' |' as markdown, o_orderkey::bigint as rows, 1::bigint as columns, case when o_orderstatus = 'F' then 'Table 1' end as caption from orders")
def engine_tables(spark, sf_dir):
    page, caption = F.expr("cast(case when o_orderkey % 2 = 0 then o_orderkey % 9 end as int)"), F.expr("case when o_orderstatus = 'F' then 'Table 1' end")
    made = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), page.alias("page"), F.concat(F.lit("| "), "o_orderstatus", F.lit(" |")).alias("markdown"), X.bigint(F.col("o_orderkey")).alias("rows"), X.bigint(F.lit(1)).alias("columns"), caption.alias("caption"))
    return E.structured_tables(made)


@R.add(
    "cell_tables",
    "with c as (select n_regionkey as doc_id, row_number() over (partition by n_regionkey order by n_nationkey) as k, n_nationkey, n_name from nation), t as (select doc_id, string_agg('| ' || case when n_nationkey % 4 = 0 then '' else n_name end || ' | ' || n_nationkey || ' |', chr(10) order by k) as body, count(*) as n from c group by doc_id) "
    "select 'tbl_0' as id, doc_id, 3 as page, '| name |  |' || chr(10) || '| --- | --- |' || chr(10) || body as markdown, n::bigint as rows, 2::bigint as columns, 'name,' as headers from t union all select 'tbl_1', doc_id, 0, '| a |' || chr(10) || '| --- |', 0::bigint, 1::bigint, 'a' from t",
)
def cell_tables(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", name.alias("n")))), lambda r: F.array(r["n"], r["n_nationkey"].cast("string"))).alias("body"))
    whole = rows.select("doc_id", F.lit(1).alias("pos"), F.lit(3).alias("page"), F.concat(F.array(F.array(F.lit("name"), F.lit(None).cast("string"))), "body").alias("cells"))
    empty = rows.select("doc_id", F.lit(0).alias("pos"), F.lit(1).alias("page"), F.slice("body", 1, 0).alias("cells"))
    one = rows.select("doc_id", F.lit(2).alias("pos"), F.lit(None).cast("int").alias("page"), F.array(F.array(F.lit("a"))).alias("cells"))
    return E.cell_tables(whole.union(empty).union(one)).withColumn("headers", F.array_join("headers", ","))


@R.add("gated_tables", "select 'tbl_0' as id, p_partkey as doc_id, 0 as page, '| k | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | ' || p_name || ' unbroken |' || chr(10) || '| 2 | ' || p_brand || ' |' as markdown, 3::bigint as rows, 2::bigint as columns, 'Table ' || p_size as caption from part where p_partkey % 2 = 0")
def gated_tables(spark, sf_dir):
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    good = F.array(row("k", "Value"), row("1", F.concat("p_name", F.lit(" un- broken"))), row("2", F.col("p_brand")))
    bad = F.array(row("k", "value"), row("1", "1"), row("", ""))
    return E.gated_tables(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(7).alias("pos"), F.lit(None).cast("int").alias("page"), F.when(F.col("p_partkey") % 2 == 0, good).otherwise(bad).alias("cells"), F.concat(F.lit("Table "), F.col("p_size").cast("string")).alias("caption")))


_FORMULA = ("l_orderkey as doc_id", "l_linenumber as pos", "case when l_linenumber % 3 > 0 then l_linenumber % 3 end as page", "concat('x_', l_linenumber) as latex", "case l_linenumber % 2 when 0 then 'block' else 'inline' end as formula_type")


@R.add("engine_formulas", "select 'formula_' || (row_number() over (partition by l_orderkey order by l_linenumber) - 1) as id, l_orderkey as doc_id, (l_linenumber % 3)::int as page, 'x_' || l_linenumber as latex, case l_linenumber % 2 when 0 then 'block' else 'inline' end as formula_type from lineitem")
def engine_formulas(spark, sf_dir):
    return E.formulas(table(spark, sf_dir, "lineitem").selectExpr(*_FORMULA))


@R.add("formula_counts", "select l_orderkey as doc_id, count(*) as formulas, count_if(l_linenumber % 2 = 1)::bigint as inline_count, count_if(l_linenumber % 2 = 0)::bigint as block_count from lineitem group by 1")
def formula_counts(spark, sf_dir):
    return E.formula_counts(table(spark, sf_dir, "lineitem").selectExpr(*_FORMULA))


@R.add("fallback_formulas", "select l_orderkey as doc_id, l_linenumber as pos, 'x_' || l_linenumber as latex from lineitem where l_linenumber % 2 = 0")
def fallback_formulas(spark, sf_dir):
    return E.block_formulas(table(spark, sf_dir, "lineitem").selectExpr(*_FORMULA)).select("doc_id", "pos", "latex")


@R.add("dual_formulas", "select c_custkey, case when c_custkey % 3 = 0 then 'f:font' else 'block:a_' || c_nationkey || ',inline:b^2' end as found from customer")
def dual_formulas(spark, sf_dir):
    markdown = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("of $b^2$ and $x$\n$$\na_"), F.col("c_nationkey").cast("string"), F.lit("\n$$ $$  $$")))
    fonts = F.array(F.struct(F.lit("font").alias("latex"), F.lit("f").alias("formula_type")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", E.dual_formulas(markdown, fonts).alias("f"))
    return rows.select("c_custkey", F.array_join(F.transform("f", lambda x: F.concat(x["formula_type"], F.lit(":"), x["latex"])), ",").alias("found"))


@R.add("engine_code", "select 'code_' || (row_number() over (partition by o_custkey order by o_orderkey) - 1) as id, o_custkey as doc_id, 0 as page, 'x = ' || o_orderkey as code, case when o_orderstatus = 'F' then 'python' end as language, 0.9::double as confidence from orders")
def engine_code(spark, sf_dir):
    return E.code_blocks(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.lit(None).cast("int").alias("page"), F.concat(F.lit("x = "), F.col("o_orderkey").cast("string")).alias("code"), F.expr("case when o_orderstatus = 'F' then 'python' end").alias("language")))


@R.add(
    "engine_regions",
    "with m as (select p_partkey, p_size from part), r as (select p_partkey, unnest(['table', 'figure', 'figure', 'formula', 'code']) as region_type, unnest([2, 0, 1, 3, 0])::int as page, unnest([0, 1, 2, 3, 4])::bigint as reading_order, p_size from m where p_partkey % 2 = 0 union all select p_partkey, unnest(['figure', 'figure', 'formula', 'code']), unnest([0, 1, 3, 0])::int, unnest([0, 1, 2, 3])::bigint, p_size from m where p_partkey % 2 = 1) "
    "select p_partkey, region_type, page, reading_order, case when region_type = 'table' or (region_type = 'figure' and page = 1) then p_size else 0 end::double as x0 from r",
)
def engine_regions(spark, sf_dir):
    from ..operators.layout import box

    b = box(F.col("p_size"), F.lit(0), F.lit(1), F.lit(1))
    item = lambda page, bbox: F.struct(page.cast("int").alias("page"), bbox.alias("bbox"))
    none = F.when(F.lit(False), b)
    tables = F.when(F.col("p_partkey") % 2 == 0, F.array(item(F.lit(2), b)))
    figures = F.array(item(F.lit(None), none), item(F.lit(1), b))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.inline(E.layout_regions(tables, figures, F.array(item(F.lit(3), b)), F.array(item(F.lit(None), b)))))
    return rows.select("p_partkey", "region_type", "page", "reading_order", "bbox.x0")


@R.add("images_in_order", "with m as (select l_orderkey as doc_id, l_linenumber % 2 as page, l_linenumber as pos, case when l_linenumber % 3 > 0 then (l_suppkey * 13 % 600)::double end as y0 from lineitem) select doc_id, page, pos, row_number() over (partition by doc_id, page order by coalesce(y0, 0), pos)::bigint - 1 as reading_order from m")
def images_in_order(spark, sf_dir):
    from ..operators.layout import box

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr("l_linenumber % 2").alias("page"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 3 > 0, box(F.lit(1), F.expr("l_suppkey * 13 % 600"), F.lit(2), F.lit(700))).alias("bbox"))
    return E.images_in_order(rows).drop("bbox")


@R.add("enriched_tables", "select p_partkey, case when p_partkey % 2 = 0 then 'a:4:' || p_name || ',b:0:own' else 'a:0:-,b:0:own' end as tables from part")
def enriched_tables(spark, sf_dir):
    t = lambda m, c: F.struct(F.lit(m).alias("markdown"), F.lit(0).alias("page"), F.lit(c).cast("string").alias("caption"))
    b = lambda kind, page, caption: F.struct(F.lit(kind).cast("string").alias("block_type"), F.lit(page).cast("int").alias("page"), caption.cast("string").alias("caption"))
    blocks = F.when(F.col("p_partkey") % 2 == 0, F.array(b("Text", 1, F.lit("no")), b(None, 1, F.lit("no")), b("BlockTable", 4, F.col("p_name")), b("table", None, F.lit("")))).otherwise(F.array(b("Figure", 2, F.lit("no"))))
    rows = table(spark, sf_dir, "part").select("p_partkey", E.enriched_tables(F.array(t("a", None), t("b", "own")), blocks).alias("t"))
    return rows.select("p_partkey", F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["markdown"], x["page"].cast("string"), F.coalesce(x["caption"], F.lit("-")))), ",").alias("tables"))


@R.add("page_tables", "select l_orderkey as doc_id, l_linenumber as page, case when l_linenumber % 3 > 0 then 'g' || l_linenumber else 't' || l_partkey end as tables from lineitem")
def page_tables(spark, sf_dir):
    geometry = F.when(F.col("l_linenumber") % 3 > 0, F.array(F.concat(F.lit("g"), F.col("l_linenumber").cast("string"))))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), geometry.alias("geometry"), F.array(F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).alias("in_text"))
    return E.page_tables(rows).withColumn("tables", F.array_join("tables", ","))


_ENGINE = "case s_suppkey % 4 when 0 then 'marker' when 1 then 'mineru' when 2 then 'docling' else 'pymupdf' end"
_FEATURE = "case s_nationkey % 5 when 0 then 'page_range' when 1 then 'code_blocks' when 2 then 'gpu_acceleration' when 3 then 'table_structure' else 'flight' end"


@R.add("engine_features", f"select s_suppkey, {_FEATURE} <> 'flight' and not ({_ENGINE} = 'marker' and {_FEATURE} = 'page_range') and not ({_ENGINE} = 'mineru' and {_FEATURE} = 'code_blocks') as supported from supplier")
def engine_features(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.supports(F.expr(_ENGINE), F.expr(_FEATURE)).alias("supported"))


_DEVICE, _MEMORY = "case c_custkey % 5 when 0 then 'cpu' when 1 then 'mps' when 2 then 'cuda' when 3 then 'xpu' else 'cuda' end", "case when c_custkey % 7 > 0 then c_custkey % 60 end"


@R.add(
    "batch_sizes",
    f"with m as (select c_custkey, {_DEVICE} as d, {_MEMORY} as g from customer), b as (select c_custkey, case when d = 'cpu' then 4 when g is null then 8 when d = 'mps' then case when g >= 48 then 32 when g >= 24 then 16 when g >= 12 then 12 else 8 end when d = 'cuda' then case when g >= 24 then 64 when g >= 12 then 32 when g >= 8 then 16 else 8 end else case when g >= 16 then 16 when g >= 8 then 12 else 8 end end as n from m) select c_custkey, n::int as layout, greatest(4, n // 2)::int as table_size from b",
)
def batch_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", E.batch_sizes(F.expr(_DEVICE), F.expr(_MEMORY)).alias("b"))
    return rows.select("c_custkey", "b.layout", F.col("b.table").alias("table_size"))


@R.add("engine_results", "select doc_id, true as success, source, 'markdown' as output_format, case when doc_id % 3 = 0 then 'worked on' else coalesce(text, '') end as markdown, case when doc_id % 3 = 0 then 2 else len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) end::bigint as word_count, case when doc_id % 3 = 0 then 9 else length(coalesce(text, '')) end::bigint as character_count, 'n=' || n_chars as metadata from documents")
def engine_results(spark, sf_dir):
    r = E.result(F.lit("docling"), F.col("source"), F.col("text"), F.lit(3), F.concat(F.lit("n="), F.col("n_chars").cast("string")), F.when(F.col("doc_id") % 3 == 0, "worked on"))
    rows = table(spark, sf_dir, "documents").select("doc_id", r.alias("r"))
    return rows.select("doc_id", *[F.col(f"r.{c}") for c in ("success", "source", "output_format", "markdown", "word_count", "character_count", "metadata")])


@R.add("rich_counts", "select o_orderkey, (o_orderkey % 3)::bigint as formula_count, case when o_orderkey % 4 = 0 then 0 else 2 end::bigint as code_block_count, 0::bigint as table_count, case when o_orderkey % 4 = 0 then 'code_block' else '' end as errors from orders")
def rich_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    c = E.rich_counts(F.array_repeat(F.lit("f"), (k % 3).cast("int")), F.when(k % 4 != 0, F.array(F.lit(1), F.lit(2))), F.array(), F.array(F.lit("i")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c.alias("c"))
    return rows.select("o_orderkey", "c.formula_count", "c.code_block_count", "c.table_count", F.array_join("c.errors", ",").alias("errors"))


@R.add("stage_summaries", "select o_orderkey, case when o_orderkey % 3 = 0 then '(no-stage)' else 'fetch(http,' || o_orderkey % 90 || 'ms,ok)→clean(-,3ms,' || case when o_orderkey % 2 = 0 then 'ok' else 'fail' end || ')' end as summary from orders")
def stage_summaries(spark, sf_dir):
    k = F.col("o_orderkey")
    record = lambda stage, method, ms, ok: F.struct(F.lit(stage).alias("stage"), F.lit(method).cast("string").alias("method"), ms.cast("double").alias("ms"), ok.alias("success"))
    records = F.when(k % 3 != 0, F.array(record("fetch", "http", k % 90, F.lit(True)), record("clean", None, F.lit(3.2), k % 2 == 0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.stage_summary(records).alias("summary"))


@R.add("merged_metadata", "select p_partkey, 'author=' || case when p_partkey % 2 = 0 then p_brand else p_name end || case when p_partkey % 2 = 0 then ',pages=3' else '' end || ',title=' || p_name as metadata from part")
def merged_metadata(spark, sf_dir):
    first = F.create_map(F.lit("title"), F.col("p_name"), F.lit("author"), F.col("p_name"))
    second = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("author"), F.col("p_brand"), F.lit("pages"), F.lit("3"))).otherwise(F.create_map().cast("map<string,string>"))
    entries = F.array_sort(F.map_entries(E.merged(first, second)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@R.add("argument_hashes", "select p_partkey, case when p_partkey % 3 = 0 then '__empty__' else sha1('{\"device\": \"' || p_brand || '\", \"mode\": ' || case when p_partkey % 2 = 0 then 'null' else '\"a\\\"b\"' end || '}') end as hash from part")
def argument_hashes(spark, sf_dir):
    some = F.create_map(F.lit("mode"), F.when(F.col("p_partkey") % 2 != 0, 'a"b'), F.lit("device"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", E.arguments_hash(F.when(F.col("p_partkey") % 3 != 0, some).otherwise(F.create_map().cast("map<string,string>"))).alias("hash"))
