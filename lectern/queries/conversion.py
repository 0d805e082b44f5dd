"""Whole documents to Markdown, made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import conversion as C
from ..operators import web as W
from ..operators.layout import box
from . import Registry, table

R = Registry()

_TEXT = "case when o_orderkey % 7 = 6 then null when o_orderkey % 3 = 0 then concat('First words.', chr(10), chr(10), 'Algorithm ', cast(o_custkey as string), ' Sort', chr(10), chr(10), 'Require: a list', chr(10), chr(10), '1: for each x do', chr(10), '2: return x', chr(10), '3: end for', chr(10), chr(10), '# Next', chr(10), chr(10), 'a line', chr(10), 'goes on') when o_orderkey % 3 = 1 then concat('THE TITLE', chr(10), chr(10), 'We come back', chr(10), 'to ', o_orderpriority, '.') else concat('## Head', chr(10), chr(10), '| a |', chr(10), '| - |', chr(10), chr(10), '<!-- Page 1 -->', chr(10), chr(10), 'x', chr(10), 'y') end"
_FENCE = "'```algorithm' || chr(10) || 'Algorithm ' || o_custkey || ' Sort' || chr(10) || 'Require: a list' || chr(10) || '1: for each x do' || chr(10) || '2: return x' || chr(10) || '3: end for' || chr(10) || '```'"


@R.add("merged_algorithms", f"select o_orderkey, case when o_orderkey % 7 = 6 then '' when o_orderkey % 3 = 0 then 'First words.' || chr(10) || chr(10) || {_FENCE} || chr(10) || chr(10) || '# Next' || chr(10) || chr(10) || 'a line' || chr(10) || 'goes on' else {_TEXT} end as merged from orders")
def merged_algorithms(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.merged_algorithms(F.expr(_TEXT)).alias("merged"))


@R.add("text_to_markdown", f"select o_orderkey, case when o_orderkey % 7 = 6 then '' when o_orderkey % 3 = 0 then 'First words.' || chr(10) || chr(10) || {_FENCE} || chr(10) || chr(10) || '# Next' || chr(10) || chr(10) || 'a line goes on' when o_orderkey % 3 = 1 then '# THE TITLE' || chr(10) || chr(10) || 'We come back to ' || o_orderpriority || '.' else '## Head' || chr(10) || chr(10) || '| a |' || chr(10) || '| - |' || chr(10) || chr(10) || '<!-- Page 1 -->' || chr(10) || chr(10) || 'x y' end as markdown from orders")
def text_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.to_markdown(F.expr(_TEXT)).alias("markdown"))


@R.add(
    "pages_assembled",
    "with l as (select l_orderkey as doc_id, l_linenumber as n, l_partkey as p, l_linenumber * 40 as y, l_linenumber * 100000 + l_partkey as no from lineitem), "
    "e as (select doc_id, y::double as y, 0 as kind, no, case when n % 4 = 3 then '![a' || p || '](f' || p || '.png)' else 'block ' || p || ' goes on' end as m from l where n % 4 <> 2 and n % 4 <> 1 "
    "union all select doc_id, y, 0, no, 'block ' || p || ' goes on' from l where n % 4 = 1 union all select doc_id, y, 1, no, '**Table ' || p || '**' || chr(10) || chr(10) || '| t |' from l where n % 4 = 2) "
    "select doc_id, '<!-- Page 3 -->' || chr(10) || chr(10) || string_agg(m, chr(10) || chr(10) order by y, kind, case when kind = 1 then m end, no) as markdown from e group by doc_id",
)
def pages_assembled(spark, sf_dir):
    """Blocks of 30 points each; every second one of four lies under a table, every third is an image, with text inside that goes.

    An image belongs to the block with its number, so numbers are wide enough that no two lines of a document share one, whatever the part.
    """
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(2).alias("page"), F.col("l_linenumber").alias("n"), F.expr("l_linenumber * 1000000000000 + l_partkey").alias("no"), F.col("l_partkey").cast("string").alias("p"))
    at = lambda top: box(F.lit(10), F.col("n") * 40 + top, F.lit(200), F.col("n") * 40 + 30)
    kind = F.col("n") % 4
    own = rows.select("doc_id", "page", F.col("no").alias("block_no"), (kind == 3).alias("is_image"), at(0).alias("bbox"), F.concat(F.lit(" block "), "p", F.lit("\n goes on")).alias("text"))
    own = own.withColumn("text", F.regexp_replace("text", "\n ", "\n"))
    inner = rows.where(kind == 3).select("doc_id", "page", (F.col("no") + 500_000_000_000).alias("block_no"), F.lit(False).alias("is_image"), at(5).alias("bbox"), F.lit("axis").alias("text"))
    tables = rows.where(kind == 2).select("doc_id", "page", at(0).alias("bbox"), F.lit("| t |").alias("markdown"), F.concat(F.lit("Table "), "p").alias("caption"))
    images = rows.where(kind == 3).select("doc_id", "page", F.col("no").alias("block_no"), F.concat(F.lit("f"), "p", F.lit(".png")).alias("filename"), F.concat(F.lit("a"), "p").alias("caption"), F.when(F.lit(False), at(0)).alias("bbox"))
    return C.document_markdown(C.page_markdown(own.union(inner), tables, images))


_MISSING = "case c_custkey % 4 when 0 then concat('a', chr(10), '<!-- formula-not-decoded -->', chr(10), 'x ∈ ', c_name, '!', chr(10), chr(10), 'b') when 1 then concat('<!--formula-not-decoded-->', chr(10), 'plain', chr(10), chr(10), chr(10), 'c') when 2 then concat('no ', c_name) else concat('end <!-- formula-not-decoded -->') end"


@R.add("has_placeholders", "select c_custkey, c_custkey % 4 <> 2 as missing from customer")
def has_placeholders(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.has_placeholders(F.expr(_MISSING)).alias("missing"))


@R.add(
    "salvaged_formulas",
    r"select c_custkey, case c_custkey % 4 when 0 then 'a' || chr(10) || '<!-- formula-not-decoded -->' || chr(10) || '$x \in Customer$#' || substr(c_name, 10) || '!' || chr(10) || chr(10) || 'b' when 1 then '<!-- formula-not-decoded -->' || chr(10) || 'plain' || chr(10) || chr(10) || chr(10) || 'c' when 2 then 'no ' || c_name else 'end <!-- formula-not-decoded -->' end as kept, "
    r"case c_custkey % 4 when 0 then 'a' || chr(10) || '$x \in Customer$#' || substr(c_name, 10) || '!' || chr(10) || chr(10) || 'b' when 1 then 'plain' || chr(10) || chr(10) || 'c' when 2 then 'no ' || c_name else 'end ' end as dropped from customer",
)
def salvaged_formulas(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MISSING).alias("kept"), F.expr(_MISSING).alias("dropped"))
    return C.salvaged(C.salvaged(rows, "kept"), "dropped", drop_rest=True)


@R.add("wrapped_commands", r"select p_partkey, case p_partkey % 3 when 0 then '$a_' || p_size || ' \leq b$; c' when 1 then '$x$ \leq ' || p_size else 'plain ' || p_name end as wrapped from part")
def wrapped_commands(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("a_"), n, F.lit(r" \leq b; c"))).when(k == 1, F.concat(F.lit(r"$x$ \leq "), n)).otherwise(F.concat(F.lit("plain "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.wrapped(text).alias("wrapped"))


@R.add(
    "embedded_images",
    "select p_partkey, '![](a.png) ![x](data:image/png;base64,' || base64(encode(p_name)) || ') ![y](data:image/jpeg;base64,AQI=) ![z](http://x/big.gif) ![t](http://x/page) ![m](http://x/m.png)' || case when p_partkey % 2 = 0 then ' ![y](data:image/jpeg;base64,AQI=) ![w](http://x/a)' else ' ![w](data:image/png;base64,' || base64(encode(p_name)) || ')' end as markdown, 7::bigint as attempted, 3::bigint as embedded, 1::bigint as skipped_large, 2::bigint as skipped_errors from part",
)
def embedded_images(spark, sf_dir):
    asset = lambda url, content, mime: F.struct(F.lit(url).alias("url"), content.alias("content"), F.lit(mime).cast("string").alias("mime"))
    assets = F.array(asset("http://x/a", F.encode("p_name", "UTF-8"), "image/png"), asset("http://x/b.JPG?s=1", F.unhex(F.lit("0102")), "text/html"), asset("http://x/big.gif", F.encode(F.repeat(F.lit("z"), 101), "UTF-8"), None), asset("http://x/page", F.unhex(F.lit("01")), "text/html"), asset("http://x/m.png", F.lit(None).cast("binary"), "image/png"))
    md = F.concat(F.lit("![](a.png) ![x](http://x/a) ![y](http://x/b.JPG?s=1) ![z](http://x/big.gif) ![t](http://x/page) ![m](http://x/m.png)"), F.when(F.col("p_partkey") % 2 == 0, " ![y](http://x/b.JPG?s=1)").otherwise(""), F.lit(" ![w](http://x/a)"))
    rows = table(spark, sf_dir, "part").select("p_partkey", C.embedded(md, assets, most=3, each=100).alias("e"))
    return rows.select("p_partkey", "e.markdown", "e.attempted", "e.embedded", "e.skipped_large", "e.skipped_errors")


@R.add("lost_images", "select page_id, case when page_id % 5 >= 3 and page_id % 2 = 0 then 'all ' || page_id % 5 || ' images were dropped' end as problem from pages")
def lost_images(spark, sf_dir):
    k = F.col("page_id")
    raw = F.concat("html", F.repeat(F.lit("<IMG src=a><imgx>"), (k % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", C.lost_images(raw, F.when(k % 2 == 0, "<p>none</p>").otherwise("<img>")).alias("problem"))


@R.add("graphics_as_images", "select page_id, '<p>' || url || '<img src=\"' || page_id || '\"/></img><graphics>' as html from pages")
def graphics_as_images(spark, sf_dir):
    html = F.concat(F.lit("<p>"), "url", F.lit('<graphic src="'), F.col("page_id").cast("string"), F.lit('"/></graphic><graphics>'))
    return table(spark, sf_dir, "pages").select("page_id", C.graphics_as_images(html).alias("html"))


@R.add("plain_markdown", "select n_nationkey, n_name || ' one' || chr(10) || chr(10) || 'two & more' || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | a\\|b |' || chr(10) || chr(10) || 'last' as markdown from nation")
def plain_markdown(spark, sf_dir):
    html = F.concat(F.lit("<nav>n</nav><h1>"), "n_name", F.lit(" one</h1>\n<script>s</script>  two &amp; more\n\n<table><tr><th>k</th><th>v</th></tr><tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>a|b</td></tr></table>last<footer>f</footer>"))
    return W.perceive(table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), "plain_markdown").select("n_nationkey", F.col("plain_markdown").alias("markdown"))


@R.add("gathered_stages", "select o_orderkey as doc_id, o_orderstatus as status, case when o_orderkey % 2 = 0 then o_custkey end as custkey, layout is null as no_layout from orders left join (select null as layout) on true")
def gathered_stages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "doc_id")
    results = {"preprocessing": orders.select("doc_id", "o_orderstatus"), "text": orders.where("doc_id % 2 = 0").select("doc_id", "o_custkey")}
    found = C.gathered(results, "preprocessing", ("text", "layout"))
    return found.select("doc_id", F.col("preprocessing.o_orderstatus").alias("status"), F.col("text.o_custkey").alias("custkey"), F.col("layout").isNull().alias("no_layout"))


@R.add("webpage_plan", "select page_id, url, true as titled, true as written from pages")
def webpage_plan(spark, sf_dir):
    """Pages by the plan of stage tools; every page of the table has a title and text."""
    from ..plans.tools import run_webpage

    rows = run_webpage(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", (F.col("title") != "").alias("titled"), (X.strip(F.col("markdown")) != "").alias("written"))


@R.add("documents_to_markdown", "select count(*) as n, sum(case when text is null or regexp_replace(text, '\\s', '', 'g') = '' then 1 else 0 end)::bigint as blank from documents")
def documents_to_markdown(spark, sf_dir):
    """Every whole text as Markdown: a text without words stays empty, every other one gives some."""
    rows = table(spark, sf_dir, "documents").select(C.to_markdown(F.col("text")).alias("md"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.count_if(X.strip(F.col("md")) == ""), F.lit(0)).alias("blank"))
