"""Formulas out of spans, image references, images among blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import spans as S
from . import Registry, table

R = Registry()


def _span(text, font, size, y):
    c = lambda v, t, n: (v if not isinstance(v, (str, int, float)) else F.lit(v)).cast(t).alias(n)
    return F.struct(c(text, "string", "text"), c(font, "string", "font"), c(size, "double", "size"), c(y, "double", "y"))


@R.add("math_fonts", "select c_custkey, c_custkey % 4 < 2 as is_math from customer")
def math_fonts(spark, sf_dir):
    k = F.col("c_custkey") % 4
    font = F.when(k == 0, "CMMI10").when(k == 1, "Cambria Math").when(k == 2, "Times").otherwise(F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.is_math_font(font).alias("is_math"))


@R.add("span_formulas", "select c_custkey, case when c_custkey % 3 = 0 then 'the $x^{2}_{n}$ is ' || c_name || '$\\alpha$' when c_custkey % 3 = 1 then 'plain ' || c_name else '' end as text from customer")
def span_formulas(spark, sf_dir):
    k, name = F.col("c_custkey") % 3, F.col("c_name")
    math = F.array(_span("the ", "Times", 10, 100), _span("x", "CMMI10", 10, 100), _span("2", "Times", 6, 94), _span("n", "Times", 6, 104), _span("", "Times", 6, 104), _span(" is ", "Times", 10, 100), _span(name, "Times", 10, 100), _span("α", "Times", 10, 100))
    plain = F.array(_span("plain ", "Times", 10, 100), _span(name, "Times", 10, 100))
    lines = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, math).when(k == 1, plain).otherwise(F.array().cast(f"array<{S.SPAN}>")).alias("spans"))
    return S.lines_with_formulas(lines).select("c_custkey", "text")


@R.add("image_references", "select p_partkey, case when p_partkey % 2 = 0 then '![a](images/' || p_brand || '.png)' else '![a](x/' || p_brand || '.gif)' end || ' ![b](data:image/png;base64,AA) ![](images/z.png) end' as markdown from part")
def image_references(spark, sf_dir):
    name = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ".png").otherwise(".gif"))
    md = F.concat(F.lit("![a](x/"), name, F.lit(") ![b](data:image/png;base64,AA) ![](images/z.png) end"))
    return table(spark, sf_dir, "part").select("p_partkey", S.rewrite_references(md, F.array(F.concat("p_brand", F.lit(".png")))).alias("markdown"))


@R.add("unplaced_images", "select p_partkey, 'see a.png' || case when p_partkey % 2 = 0 then '' else chr(10) || chr(10) || '## Extracted Images' || chr(10) || chr(10) || '![' || p_name || '](b.png)' end as markdown from part")
def unplaced_images(spark, sf_dir):
    image = lambda n, c: F.struct(n.alias("filename"), c.alias("caption"))
    images = F.array(image(F.lit("a.png"), F.lit(None).cast("string")), image(F.when(F.col("p_partkey") % 2 == 0, "a.png").otherwise("b.png"), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", S.with_unplaced_images(F.lit("see a.png"), images).alias("markdown"))


@R.add("matched_images", "select p_partkey, case when p_size % 2 = 0 then '1,0,' else '1,2,' end as places from part")
def matched_images(spark, sf_dir):
    d = lambda *v: L.box(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    even = F.col("p_size") % 2 == 0
    far = F.when(even, 10).otherwise(300)
    images = F.array(d(far, 0, far + 20, 20), d(0, 0, 90, 90), d(60, 110, 70, 120))
    blocks = F.array(d(0, 0, 100, 100), F.when(even, d(0, 0, 40, 40)).otherwise(d(40, 100, 50, 105)), d(900, 900, 910, 910))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(S.matched_images(blocks, images), lambda k: F.coalesce(k.cast("string"), F.lit(""))), ",").alias("places"))


@R.add("span_lines", "select l_orderkey, arg_min(size, (-n, size)) as normal_size, max(lines) as spans, any_value(y) as baseline from (select l_orderkey, l_linenumber::double as size, count(*) as n, any_value(ys[1 + len(ys) // 2]) as y, any_value(len(ys)) as lines from (select *, list(l_suppkey::double order by l_suppkey) over (partition by l_orderkey rows between unbounded preceding and unbounded following) as ys from lineitem) group by l_orderkey, l_linenumber) group by l_orderkey")
def span_lines(spark, sf_dir):
    """Usual size (the smallest of equally frequent ones) and baseline (upper median) of lines of spans; spans without text count for neither."""
    blank = F.array(_span(" ", "Times", 99, 9), _span(F.lit(None), "Times", 98, 9))
    span = F.struct(F.lit("x").alias("text"), F.lit("Times").alias("font"), F.col("l_linenumber").cast("double").alias("size"), F.col("l_suppkey").cast("double").alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("spans"), F.concat(F.collect_list(span), blank).alias("s"))
    return rows.select("l_orderkey", S.normal_size(F.col("s")).alias("normal_size"), "spans", S.baseline(F.col("s")).alias("baseline"))


@R.add("math_symbols", "select p_partkey, p_partkey % 4 in (0, 1) as there from part")
def math_symbols(spark, sf_dir):
    from ..functions import latex as X

    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat("p_name", F.lit(" ≤ 1"))).when(k == 1, "𝔼[x²]").when(k == 2, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.has_symbols(text).alias("there"))


@R.add("page_numbers", "select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then 0 else greatest(0, o_orderkey % 9 - 1) end::int as page from orders")
def page_numbers(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    given = F.when(k == 0, "one").when(k == 1, "-3").otherwise((F.col("o_orderkey") % 9).cast("string"))
    page = F.when(given.try_cast("int").isNotNull(), L.zero_based(given))
    return table(spark, sf_dir, "orders").select("o_orderkey", page.alias("page"))


@R.add("array_helpers", "select p_partkey, p_brand || ',' || p_type as seen, p_brand || ',' || case when p_partkey % 2 = 0 then ',' else p_type || ',' end as padded, round(1 - 3 / greatest(length(p_name), 1), 3)::double as reduced from part where p_brand <> p_type")
def array_helpers(spark, sf_dir):
    from ..functions import text as X

    rows = table(spark, sf_dir, "part").where("p_brand <> p_type")
    row = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_type"))
    seen = X.first_seen(F.array("p_brand", "p_type", "p_brand", "p_type"))
    return rows.select("p_partkey", F.array_join(seen, ",").alias("seen"), F.array_join(X.padded(row, F.lit(3)), ",").alias("padded"), X.reduction(F.col("p_name"), F.lit("abc")).alias("reduced"))
