"""Whole documents, LaTeX and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import latex as L
from ..functions import text as X
from ..operators import documents as D
from . import Registry, table

R = Registry()

_ALGO = "concat('Some words come first.', chr(10), chr(10), case when o_orderkey % 3 = 0 then concat('Algorithm ', cast(o_custkey as string), ' Sort', chr(10), chr(10), 'Require: a list', chr(10), chr(10), '1: for each x do', chr(10), '2: return x', chr(10), '3: end for') else 'We return to this.' end, chr(10), chr(10), '# Next', chr(10), chr(10), 'if it rains.')"


@R.add("algorithm_regions", "select o_orderkey, 'Algorithm ' || cast(o_custkey as varchar) || ' Sort' as title, 1::bigint as start_idx, 4::bigint as end_idx, round(14 / 15.0, 6)::double as confidence from orders where o_orderkey % 3 = 0")
def algorithm_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.inline(D.algorithm_regions(F.expr(_ALGO))))
    return rows.select("o_orderkey", "title", "start_idx", "end_idx", F.round("confidence", 6).alias("confidence"))


@R.add("paragraphs", "with l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, trim(unnest(string_split(text, chr(10)))) as s from documents), n as (select *, lag(s) over (partition by doc_id order by pos) as p from l), g as (select *, sum(case when p is null or (regexp_matches(p, '[.?!:]$') and regexp_matches(s, '^\\p{Lu}')) then 1 else 0 end) over (partition by doc_id order by pos) - 1 as k from n), h as (select *, max(k) over (partition by doc_id) as last from g) select doc_id, k::bigint as pos, case when any_value(last) = 0 then string_agg(s, chr(10) order by pos) else string_agg(s, ' ' order by pos) end as paragraph from h group by doc_id, k")
def paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(D.split_paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.select("doc_id", X.bigint(F.col("pos")).alias("pos"), "paragraph")


@R.add("image_places", "select p_partkey, '1,' || case when p_partkey % 2 = 0 then '2' else '0' end || ',1' as places from part")
def image_places(spark, sf_dir):
    paragraphs_ = F.array(F.lit("all begins"), F.concat(F.lit("here a "), F.upper("p_name"), F.lit(" stands")), F.concat(F.lit("brand "), "p_brand"))
    alts = F.array(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_brand"), F.lit(" "))).otherwise("begins"), F.lit("image"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(D.image_places(paragraphs_, alts), ",").alias("places"))


@R.add("simple_markdown", "select p_partkey, '# INTRO' || chr(10) || chr(10) || '## what follows:' || chr(10) || chr(10) || 'the ' || p_name || ' is' || ' sold by us' || chr(10) || chr(10) || '| a |' || chr(10) || chr(10) || 'small words only here' as markdown from part")
def simple_markdown(spark, sf_dir):
    text = F.concat(F.lit("INTRO\n\n<!-- Page 1 -->\n\nwhat follows:\n\nthe "), "p_name", F.lit(" is\n sold by us\n\n| a |\n\n\n\nsmall words only here"))
    return table(spark, sf_dir, "part").select("p_partkey", D.simple_markdown(text).alias("markdown"))


@R.add("merged_cells", "select p_partkey, 'k,value;1,' || p_name || ' unbroken more;2,' || p_brand as cells from part")
def merged_cells(spark, sf_dir):
    row = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    data = F.array(row("k", "value", ""), row("1", F.col("p_name"), "un- broken"), row("", "", "more"), row("2", F.concat(F.lit("<br> "), "p_brand"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(D.merged_cells(data), lambda r: F.array_join(r, ",")), ";").alias("cells"))


_PAGES = "l_orderkey as doc_id, l_linenumber - 1 as page, l_partkey % 3 as images, l_suppkey % 5 as math_fonts"


@R.add("characteristics", "with p as (select l_orderkey as doc_id, l_linenumber - 1 as page, (l_quantity * 20)::int as chars, l_partkey % 3 as images, l_suppkey % 5 as fonts from lineitem), s as (select doc_id, count(*) as scanned, sum(chars + 12) as chars, sum(images) as images, sum(fonts) as fonts, count(*) as piped from p where page < 5 group by doc_id) select doc_id, scanned, piped > 2 as has_tables, fonts > 3 as has_formulas, false as has_code_blocks, images > 0 as has_images, case when chars / scanned < 200 then 'sparse' when chars / scanned > 2000 then 'dense' else 'normal' end as text_density, chars / scanned < 200 as is_scanned, piped > 2 or fonts > 3 or images > 0 as has_complex_layout from s")
def characteristics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.expr(c) for c in _PAGES.split(", ")], F.concat(F.lit("| a | b b |\n"), F.repeat(F.lit("x"), (F.col("l_quantity") * 20).cast("int"))).alias("text"))
    return D.characteristics(rows)


@R.add("pdf_batch_all", "select count(*) as total, count_if(o_orderstatus <> 'F')::bigint as successful_count, count_if(o_orderstatus = 'F')::bigint as failed_count, sum(o_custkey % 40)::bigint as total_pages, sum(o_orderkey % 900)::bigint as total_words, count_if(o_orderstatus <> 'F') / count(*) as success_rate from orders")
def pdf_batch_all(spark, sf_dir):
    return D.batch_summary(_results(spark, sf_dir), False)


@R.add("pdf_batch_successes", "select count(*) as total, count_if(o_orderstatus <> 'F')::bigint as successful_count, count_if(o_orderstatus = 'F')::bigint as failed_count, (sum(o_custkey % 40) filter (o_orderstatus <> 'F'))::bigint as total_pages, (sum(o_orderkey % 900) filter (o_orderstatus <> 'F'))::bigint as total_words, count_if(o_orderstatus <> 'F') / count(*) as success_rate from orders")
def pdf_batch_successes(spark, sf_dir):
    return D.batch_summary(_results(spark, sf_dir), True)


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "F").alias("success"), (F.col("o_custkey") % 40).alias("pages"), (F.col("o_orderkey") % 900).alias("words"))


@R.add("response_views", "select p_partkey, '# ' || p_name || chr(10) || '- words: ' || cast(p_size as varchar) || chr(10) || p_type as as_markdown, p_name || chr(10) || p_type as as_plain from part")
def response_views(spark, sf_dir):
    parts = (F.col("p_name"), F.lit(None).cast("string"), F.col("p_size"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", D.as_view(*parts, "markdown").alias("as_markdown"), D.as_view(*parts, "plain").alias("as_plain"))


_DOMAIN = "regexp_extract(url, '://([^/?#]*)', 1)"


@R.add("robots_allowed", f"select page_id, url from pages where not ({_DOMAIN} in (select {_DOMAIN} from pages where page_id % 2 = 0) and regexp_matches(url, '^[a-z]+://[^/?#]*/fr/'))")
def robots_allowed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = F.when(F.col("page_id") % 2 == 0, "User-agent: *\nDisallow: /fr/\nDisallow: /fr$\n")
    robots = pages.select(X.domain(F.col("url")).alias("domain"), rules.alias("txt")).where("txt is not null").groupBy("domain").agg(F.min("txt").alias("txt"))
    return D.allowed_by_robots(pages, robots)


@R.add("latex_symbols", "select c_custkey, 'x \\leq y^{2} and \\alpha \\in \\mathbb{R}, ' || c_name || '_{1}' as latex, true as has_symbols from customer")
def latex_symbols(spark, sf_dir):
    text = F.concat(F.lit("x ≤ y² and α∈ℝ, "), "c_name", F.lit("₁"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.unicode_to_latex(text).alias("latex"), L.has_symbols(text).alias("has_symbols"))


@R.add("latex_repaired", "select c_custkey, 'f_{field} x^{2} \\text{a} = ' || cast(c_custkey as varchar) || ' \\qquad (7)' as latex from customer")
def latex_repaired(spark, sf_dir):
    text = F.concat(F.lit("\\begin{align*}f _ { f i e l d } x ^ { 2 } \\ text{a} & = "), F.col("c_custkey").cast("string"), F.lit("\\tag{7}\\end{align*}"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.repaired(text).alias("latex"))


@R.add("slugs", "select p_partkey, lower(replace(p_name, ' ', '-')) || '-cafe-' || cast(p_partkey as varchar) as slug from part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", L.slug(F.concat("p_name", F.lit("  Café: #-"), F.col("p_partkey").cast("string"), F.lit("!"))).alias("slug"))


@R.add("asset_ids", "select l_orderkey, l_linenumber, 'table_' || cast(l_partkey as varchar) || '_' || cast(l_linenumber as varchar) as asset_id from lineitem")
def asset_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.asset_id(F.lit("table"), F.col("l_partkey"), F.col("l_linenumber")).alias("asset_id"))


@R.add("html_of_text", "select p_partkey, '<html><head>' || chr(10) || '<title>' || p_name || '</title>' || chr(10) || '</head><body>' || chr(10) || '<div class=''main-content''>' || chr(10) || '<p>' || p_brand || '</p>' || chr(10) || '<p>' || p_type || '</p>' || chr(10) || '</div>' || chr(10) || '<div class=''links''>' || chr(10) || '<a href=''https://x.org/' || cast(p_partkey as varchar) || '''>' || 'https://x.org/' || cast(p_partkey as varchar) || '</a><br>' || chr(10) || '</div>' || chr(10) || '</body></html>' as html from part")
def html_of_text(spark, sf_dir):
    text = F.concat(F.col("p_brand"), F.lit("\n\n \n\n"), F.col("p_type"))
    link = F.struct(F.concat(F.lit("https://x.org/"), F.col("p_partkey").cast("string")).alias("url"), F.lit(None).cast("string").alias("text"))
    return table(spark, sf_dir, "part").select("p_partkey", D.html_of_text(text, F.col("p_name"), F.array(link)).alias("html"))


@R.add("image_names", "select p_partkey, case p_partkey % 4 when 0 then lower(replace(p_name, ' ', '-')) when 1 then 'im1' when 2 then 'near-the-' || lower(p_type) || '-part' else 'doc-p3-' || cast(p_partkey as varchar) end as name from part")
def image_names(spark, sf_dir):
    k, none = F.col("p_partkey") % 4, F.lit(None).cast("string")
    caption, xref = F.when(k == 0, F.col("p_name")), F.when(k <= 1, "Im1")
    nearby = F.when(k == 2, F.concat(F.lit("near the "), "p_type", F.lit(" part"))).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", D.image_name(caption, xref, nearby, F.lit("doc"), F.lit(3), F.col("p_partkey")).alias("name"))


@R.add("source_errors", "select page_id, case when page_id % 5 = 0 then 'Invalid URL format' when page_id % 7 = 0 then 'no content' end as error from pages")
def source_errors(spark, sf_dir):
    from ..sources.tables import scan_errors

    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "nowhere").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 != 0, F.col("html")).alias("html"))
    return scan_errors(pages).select("page_id", "error")
