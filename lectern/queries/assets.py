"""Competing engines, assets, harvests, JSON and tables in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assets as A
from ..operators import compete as C
from ..operators import tables as B
from . import Registry, table

R = Registry()

_ENGINES = "('docling', 2), ('mineru', 1), ('marker', 3), ('pymupdf', 4)"
_CONTENT = "concat('# ', s_name, chr(10), case when (s_suppkey + rank) % 3 = 0 then concat('| a | b |', chr(10), '|---|---|', chr(10), '| ', engine, ' | ', cast(s_nationkey as string), ' |', chr(10)) else '' end, case when (s_suppkey + rank) % 4 = 1 then concat('$$', engine, '$$', chr(10)) else '' end, case when s_suppkey % 5 = rank then concat('```sql', chr(10), 'select ', cast(s_suppkey as string), chr(10), '```') else '' end)"
_CANDIDATES = f"select s_suppkey as doc_id, engine, rank, (s_suppkey * 7 + rank) % 5 <> 0 and s_suppkey % 50 <> 7 as success, case when (s_suppkey + rank) % 11 = 0 then '' else {_CONTENT} end as content from supplier cross join (values {_ENGINES}) as e(engine, rank)"
_SCORE = "len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 0.001 + len(regexp_extract_all(content, '(?m)^#{1,6}\\s+')) * 5.0 + len(regexp_extract_all(content, '(?m)^\\s*\\|')) * 3.0 + len(regexp_extract_all(content, '\\$\\$[^$]+\\$\\$')) * 10.0 + (len(content) - len(replace(content, '```', ''))) // 3 // 2 * 5.0"
_PRIORITY = "case engine when 'docling' then 10 when 'mineru' then 8 when 'marker' then 6 else 4 end"


def candidates(spark, sf_dir):
    engines = F.array(*[F.struct(F.lit(n).alias("engine"), F.lit(r).alias("rank")) for n, r in (("docling", 2), ("mineru", 1), ("marker", 3), ("pymupdf", 4))])
    each = table(spark, sf_dir, "supplier").select("*", F.inline(engines))
    return each.select(F.col("s_suppkey").alias("doc_id"), "engine", "rank", F.expr("(s_suppkey * 7 + rank) % 5 <> 0 and s_suppkey % 50 <> 7").alias("success"), F.expr(f"case when (s_suppkey + rank) % 11 = 0 then '' else {_CONTENT} end").alias("content"))


@R.add("engine_gates", f"with c as ({_CANDIDATES}) select engine, min(rank) as rank, count(*) as n from c where engine <> 'marker' and doc_id % 3 <> 0 group by engine")
def engine_gates(spark, sf_dir):
    tools = candidates(spark, sf_dir).withColumn("enabled", F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True))
    return C.gated(tools, {"marker": False, "docling": True}).groupBy("engine").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))


@R.add("engine_fallback", f"with c as ({_CANDIDATES}), b as (select doc_id, engine, content, row_number() over (partition by doc_id order by rank) as k from c where success) select d.doc_id, b.engine, b.content, case when b.engine is null then 'all tools failed' end as error from (select distinct doc_id from c) d left join b on b.doc_id = d.doc_id and k = 1")
def engine_fallback(spark, sf_dir):
    return C.fallback(candidates(spark, sf_dir))


@R.add("engine_competition", f"with c as ({_CANDIDATES}), s as (select *, {_SCORE} + 2 * {_PRIORITY} as score from c where rank <= 3 and success and content <> ''), b as (select *, row_number() over (partition by doc_id order by round(score, 6) desc, rank) as k from s) select doc_id, engine, content, round(score, 6)::double as score from b where k = 1")
def engine_competition(spark, sf_dir):
    return C.compete(candidates(spark, sf_dir)).withColumn("score", F.round("score", 6))


_COUNTS = "len(regexp_extract_all(content, '(?m)^\\s*\\|')) as t, len(regexp_extract_all(content, '\\$\\$[^$]+\\$\\$')) as f, (len(content) - len(replace(content, '```', ''))) // 6 as k"


@R.add(
    "engine_synthesis",
    f"with c as ({_CANDIDATES}), s as (select *, {_SCORE} + case engine when 'docling' then 16.0 when 'pymupdf' then 10.0 else 0.0 end as score, {_COUNTS} from c where success), b as (select *, row_number() over w as place, lead(engine) over w as other, lead(t) over w as t2, lead(f) over w as f2, lead(k) over w as k2 from s window w as (partition by doc_id order by round(score, 6) desc, rank)) "
    "select doc_id, engine, other, array_to_string(list_filter([case when t2 > t * 1.5 then 'tables' end, case when f2 > f * 1.5 then 'formulas' end, case when k2 > k * 1.5 then 'code_blocks' end], lambda x: x is not null), ',') as supplements from b where place = 1",
)
def engine_synthesis(spark, sf_dir):
    return C.synthesize(candidates(spark, sf_dir), {"docling": 8, "pymupdf": 5}).select("doc_id", "engine", "other", F.array_join("supplements", ",").alias("supplements"))


@R.add("engine_merge")
def engine_merge(spark, sf_dir):
    """The merged text of each document; unit tests hold the results."""
    rows = C.synthesize(candidates(spark, sf_dir), {"docling": 8, "pymupdf": 5})
    return rows.select("doc_id", C.merged(F.col("content"), F.col("other_content"), F.col("supplements")).alias("markdown"))


@R.add(
    "image_budget",
    "with recursive i as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as k, (l_partkey % 60)::bigint as size from lineitem), f as (select doc_id, 1 as k, case when size <= 50 and size <= 90 then size else 0 end as used, case when size <= 50 then 1 else 0 end as kept from i where k = 1 union all select i.doc_id, i.k, case when i.size <= 50 and f.used + i.size <= 90 then f.used + i.size else f.used end, f.kept + case when i.size <= 50 and f.used + i.size <= 90 then 1 else 0 end from f join i on i.doc_id = f.doc_id and i.k = f.k + 1) "
    "select doc_id, max_by(kept, k)::bigint as kept, max_by(used, k)::bigint as used from f group by doc_id",
)
def image_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    kept = A.within_budget(F.col("items"), lambda i: i["l_partkey"] % 60, 50, 90)
    return rows.select("doc_id", kept.alias("kept")).select("doc_id", X.bigint(F.size("kept")).alias("kept"), F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, i: a + i["l_partkey"] % 60).alias("used"))


@R.add("images_placed", "select p_partkey, 'a ' || case when p_partkey % 3 = 0 then '![](images/x.png)' else '![' || p_name || '](images/' || p_brand || '.png)' end || ' b ' || case when p_partkey % 3 = 0 then '<!-- image -->' else '![](images/x.png)' end || ' c <!-- image -->' as markdown from part")
def images_placed(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 != 0, F.concat("p_brand", F.lit(".png")))
    md = A.place_images(F.lit("a <!-- image --> b <!-- image --> c <!-- image -->"), F.array(name, F.lit("x.png")), F.array(F.col("p_name"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", md.alias("markdown"))


@R.add("formulas_placed", "select c_custkey, 'a $$' || chr(10) || 'x_{' || cast(c_nationkey as varchar) || '}' || chr(10) || '$$' || case when c_custkey % 2 = 0 then ' (' || cast(c_custkey as varchar) || ')' else '' end || ' b <!-- formula-not-decoded --> c' as markdown, contains(c_name, 'x') as has_placeholder from customer")
def formulas_placed(spark, sf_dir):
    f = lambda latex, kind, n: F.struct(latex.alias("latex"), F.lit(kind).alias("formula_type"), n.alias("equation_number"))
    none = F.lit(None).cast("string")
    items = F.array(f(F.lit("y"), "inline", none), f(F.concat(F.lit("x_{"), F.col("c_nationkey").cast("string"), F.lit("}")), "block", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string"))))
    md = A.place_formulas(F.lit("a <!-- formula-not-decoded --> b <!-- formula-not-decoded --> c"), items)
    return table(spark, sf_dir, "customer").select("c_custkey", md.alias("markdown"), F.col("c_name").contains("x").alias("has_placeholder"))


@R.add(
    "asset_summary",
    "with e as (select l_orderkey as doc_id, l_linenumber % 4 as k, case when l_partkey % 2 = 0 then 'sql' else l_returnflag end as language, l_suppkey % 9 as r, l_quantity::bigint as q, l_partkey % 3 = 0 as b from lineitem) select doc_id, count_if(k = 0)::bigint as images, count_if(k = 1)::bigint as tables, count_if(k = 2)::bigint as formulas, count_if(k = 3)::bigint as code_blocks, count_if(k = 2 and b)::bigint as block_formulas, count_if(k = 2 and not b)::bigint as inline_formulas, coalesce(sum(r) filter (k = 1), 0)::bigint as table_rows, coalesce(sum(r + 1) filter (k = 1), 0)::bigint as table_columns, coalesce(sum(q) filter (k = 0), 0)::bigint as image_bytes, coalesce(string_agg(distinct language, ',' order by language) filter (k = 3), '') as languages from e group by doc_id",
)
def asset_summary(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "image").when(k == 1, "table").when(k == 2, "formula").otherwise("code")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), kind.alias("kind"), F.when(F.col("l_partkey") % 2 == 0, "sql").otherwise(F.col("l_returnflag")).alias("language"), (F.col("l_suppkey") % 9).alias("rows"), (F.col("l_suppkey") % 9 + 1).alias("columns"), F.when(F.col("l_partkey") % 3 == 0, "block").otherwise("inline").alias("formula_type"), F.col("l_quantity").cast("bigint").alias("size"))
    return A.asset_summary(rows)


_MD = "concat('x', chr(10), '```sql', chr(10), 'select ', cast(o_orderkey as string), chr(10), '```', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', o_orderstatus, ' | 2 |', chr(10), 'costs $a_', cast(o_custkey as string), '$ or $$', chr(10), 'b^2', chr(10), '$$ and $c$.')"


@R.add("code_harvest", "select o_orderkey, 'sql' as language, 'select ' || cast(o_orderkey as varchar) as code from orders")
def code_harvest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(A.code_harvest(F.expr(_MD))))


@R.add("table_harvest", "select o_orderkey, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderstatus || ' | 2 |' as markdown, 1::bigint as rows, 2::bigint as columns from orders")
def table_harvest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(A.table_harvest(F.expr(_MD))))


@R.add("formula_harvest", "select o_orderkey, 'b^2' as latex, 'block' as formula_type from orders union all select o_orderkey, 'a_' || cast(o_custkey as varchar), 'inline' from orders")
def formula_harvest(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(A.formula_harvest(F.expr(_MD))))


@R.add("formulas_in_text", "select o_orderkey, 'k+' || cast(o_custkey as varchar) as latex, 'block' as formula_type from orders union all select o_orderkey, 'p = q', 'inline' from orders union all select o_orderkey, 'mm', 'inline' from orders")
def formulas_in_text(spark, sf_dir):
    text = F.concat(F.lit("see \\[ k+"), F.col("o_custkey").cast("string"), F.lit(" \\] then \\(p = q\\), $z$ and $mm$"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(A.formulas_in_text(text)))


@R.add("content_list", "select event_id, '# ' || event_type || chr(10) || chr(10) || 'by ' || cast(user_id as varchar) || chr(10) || chr(10) || '$$' || chr(10) || 'k=' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '$$' || chr(10) || chr(10) || '![c](i.png)' as markdown from events")
def content_list(spark, sf_dir):
    json = F.concat(F.lit('[{"type":"text","text_level":1,"text":"'), "event_type", F.lit('"},{"type":"text","text":"by '), F.col("user_id").cast("string"), F.lit('"},{"type":"equation","latex":"k='), F.regexp_extract("props", "([0-9]+)", 1), F.lit('"},{"type":"footer","text":"no"},{"type":"image","img_path":"i.png","caption":"c"}]'))
    return table(spark, sf_dir, "events").select("event_id", A.content_markdown(A.content_list(json)).alias("markdown"))


@R.add("parsed_responses", "select event_id, case when event_id % 3 = 2 then null else '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' end as value, case when event_id % 3 = 2 then 'not JSON' end as error from events")
def parsed_responses(spark, sf_dir):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("well, "), "props"))
    found = A.parse_response(said)
    return table(spark, sf_dir, "events").select("event_id", found["value"].alias("value"), found["error"].alias("error"))


@R.add("html_table_shapes", "select n_regionkey, count(*) + 1 as rows, 2::bigint as columns from nation group by n_regionkey")
def html_table_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td >x</td></tr>"))), "").alias("body"))
    shape = A.html_table_shape(F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr>"), "body", F.lit("</table>")))
    return rows.select("n_regionkey", shape["rows"].alias("rows"), shape["columns"].alias("columns"))


_PIPES = "concat('Some words before.', chr(10), '| Name | Size ', case when p_partkey % 4 = 1 then '' else '| Price ' end, '|', chr(10), '|---|---|---|', chr(10), case when p_partkey % 4 = 2 then '| x | ' else concat('| ', p_name, ' | ') end, cast(p_size as string), ' | ', case when p_partkey % 4 = 2 then '' else p_brand end, ' |', chr(10), '| ', p_type, ' | 7 | 9.5 |', chr(10), 'and after.')"


@R.add("tables_in_text", "select p_partkey, 0 as table_no, '| Name | Size ' || case when p_partkey % 4 = 1 then '' else '| Price ' end || '|' || chr(10) || case when p_partkey % 4 = 1 then '| --- | --- |' else '| --- | --- | --- |' end || chr(10) || case when p_partkey % 4 = 2 then '| x | ' || cast(p_size as varchar) || ' |' else '| ' || p_name || ' | ' || cast(p_size as varchar) || ' | ' || p_brand || ' |' end || chr(10) || '| ' || p_type || ' | 7 | 9.5 |' as markdown, 3::bigint as rows, case when p_partkey % 4 = 1 then 2::bigint else 3::bigint end as columns from part")
def tables_in_text(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PIPES).alias("t"))
    return B.tables_in_text(docs, "p_partkey", "t").select("p_partkey", "table_no", "markdown", "rows", "columns")


@R.add("table_gate", "select p_partkey, case p_partkey % 6 when 0 then 'pass' when 1 then 'low_occupancy' when 2 then 'low_uniqueness' when 3 then 'too_few_rows' when 4 then 'too_few_cols' else 'too_many_weak_cols' end as reason, p_partkey % 6 = 0 as passed from part")
def table_gate(spark, sf_dir):
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    k, name, brand = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_brand")
    size = F.col("p_size").cast("string")
    data = (
        F.when(k == 0, F.array(row("Name", "Size", "Brand"), row(name, size, brand), row("Next", "900", "B")))
        .when(k == 1, F.array(row(name, "", ""), row("", "", "x"), row("", "", "")))
        .when(k == 2, F.array(row("a", "b"), row("a", "b"), row("b", "a")))
        .when(k == 3, F.array(row(name, brand)))
        .when(k == 4, F.array(row(name), row(brand)))
        .otherwise(F.array(row("1", "2", "", "", ""), row("3", "4", "5", "", ""), row("6", "7", "", "8", "9"), row("10", "11", "", "", "")))
    )
    gate = B.quality(data)
    return table(spark, sf_dir, "part").select("p_partkey", gate["reason"].alias("reason"), gate["passed"].alias("passed"))


@R.add("cells_to_markdown", "select n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || cast(n_nationkey as varchar) || ' | ' || n_name || '\\|x |', chr(10) order by n_nationkey) as markdown from nation group by n_regionkey")
def cells_to_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    data = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("r", lambda r: F.array(r["n_nationkey"].cast("string"), F.concat(r["n_name"], F.lit("|x")), F.lit("beyond"))))
    return rows.select("n_regionkey", B.markdown_of_cells(data).alias("markdown"))
