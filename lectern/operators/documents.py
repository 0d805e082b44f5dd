"""Whole documents: pseudo code regions, paragraphs, images among paragraphs, characteristics, summaries, views, robots rules."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from ..functions.markdown import code_fence

#: Points from which a paragraph goes on with a titled region, and from which it is one by itself.
GOES_ON, ALONE, FULL = 3, 7, 15


def algorithm_regions(text: Column) -> Column:
    """array<struct<title, content, start_idx, end_idx, confidence>> of pseudo code in text of paragraphs.

    A title opens a region; header lines and paragraphs with enough points belong to it, until another title, a heading or a numbered
    section comes. A fold over the paragraphs.
    """
    part = "struct<title:string,start_idx:bigint,end_idx:bigint,parts:array<string>>"
    paragraphs = F.transform(F.split(X.or_empty(text), "\n\n", -1), X.strip)
    none = F.lit(None).cast(part)

    def region(p: Column, i: Column, end: Column) -> Column:
        return F.struct(X.strip(F.get(F.split(p, "\n"), 0)).alias("title"), i.alias("start_idx"), end.alias("end_idx"), F.array(p).alias("parts"))

    def closed(r: Column, end: Column) -> Column:
        return F.struct(r["title"].alias("title"), r["start_idx"].alias("start_idx"), end.alias("end_idx"), r["parts"].alias("parts"))

    def step(state: Column, item: Column) -> Column:
        p, i = item["p"], item["i"]
        titled, score = p.rlike(S.ALGORITHM_TITLE), item["score"]
        stops = titled | p.rlike(r"^#{1,6}\s") | (p.rlike(r"^\d+(\.\d+)*\s+[A-Z]") & ~p.rlike(S.NUMBERED))
        open_ = state["open"]
        header = p.rlike(r"(?i)^(?:Require|Ensure|Input|Output|Precondition|Postcondition)\s*:")
        stays = open_.isNotNull() & ~stops & (header | (score >= GOES_ON))
        longer = F.struct(open_["title"].alias("title"), open_["start_idx"].alias("start_idx"), open_["end_idx"].alias("end_idx"), F.concat(open_["parts"], F.array(p)).alias("parts"))
        alone = ~stays & ~titled & (score >= ALONE)
        done = F.concat(
            state["done"],
            F.when(~stays & open_.isNotNull(), F.array(closed(open_, i))).otherwise(F.array().cast(f"array<{part}>")),
            F.when(alone, F.array(region(p, i, i + 1))).otherwise(F.array().cast(f"array<{part}>")),
        )
        now = F.when(stays, longer).when(titled, region(p, i, i)).otherwise(none)
        return F.when(p == "", state).otherwise(F.struct(done.alias("done"), now.alias("open")))

    begin = F.struct(F.array().cast(f"array<{part}>").alias("done"), none.alias("open"))
    items = F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), X.bigint(i).alias("i"), S.algorithm_score(p).alias("score")))

    def finish(n: Column):
        return lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(closed(s["open"], n)))).otherwise(s["done"])

    found = X.let(items, lambda xs: F.aggregate(xs, begin, step, finish(X.bigint(F.size(xs)))))
    content = lambda r: F.array_join(r["parts"], "\n\n")
    return F.transform(found, lambda r: F.struct(r["title"].alias("title"), content(r).alias("content"), r["start_idx"].alias("start_idx"), r["end_idx"].alias("end_idx"), F.least(F.lit(1.0), S.algorithm_score(content(r)) / FULL).alias("confidence")))


def split_paragraphs(text: Column) -> Column:
    """Paragraphs by blank lines, or where a line ends a sentence and the next begins with a capital; lines are joined."""
    marked = F.regexp_replace(X.or_empty(text), r"([.?!:])[^\S\n]*\n(?=[^\S\n]*\p{Lu})", "$1\n\n")
    parts = F.transform(F.split(marked, r"\n[^\S\n]*\n\s*"), lambda p: X.strip(F.regexp_replace(X.strip(p), r"\s*\n\s*", " ")))
    kept = F.filter(parts, lambda p: p != "")
    return X.let(kept, lambda k: F.when(F.size(k) > 1, k).otherwise(F.array(X.strip(X.or_empty(text)))))


def image_places(paragraphs: Column, alts: Column) -> Column:
    """For each image the paragraph that it follows: the first that holds its alt text, else spread evenly."""
    generic = ("", "image", "img", "photo", "picture", "icon", "logo")
    n = F.size(paragraphs)

    def matched(alt: Column) -> Column:
        low = F.lower(X.strip(X.or_empty(alt)))
        hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lower(F.get(paragraphs, i)).contains(low))
        return F.when(~low.isin(*generic), F.get(hits, 0))

    def placed(found: Column) -> Column:
        rest = F.size(F.filter(found, lambda f: f.isNull()))
        before = lambda i: F.size(F.filter(F.slice(found, F.lit(1), i), lambda f: f.isNull()))
        return F.transform(found, lambda f, i: F.coalesce(f, F.least(F.floor((before(i) + 1) * n / (rest + 1)).cast("int"), n - 1)))

    return X.let(F.transform(alts, matched), placed)


def simple_markdown(text: Column) -> Column:
    """Markdown of plain paragraphs: short lines that look like titles become headings, pseudo code a fence, other lines are joined."""

    def one(paragraph: Column) -> Column:
        rows = F.filter(F.transform(F.split(paragraph, "\n"), X.strip), lambda s: s != "")
        only, joined = F.get(rows, 0), F.array_join(rows, "\n")
        n = F.size(X.words(only))
        capitals = (only == F.upper(only)) & (only != F.lower(only))
        single = F.when(capitals & (n <= 5), F.concat(F.lit("# "), only)).when(only.endswith(":") & (n <= 8), F.concat(F.lit("## "), only)).when(X.title_like(only), F.concat(F.lit("# "), only)).otherwise(only)
        whole = paragraph.startswith("![") | paragraph.startswith("|") | (paragraph.startswith("**") & paragraph.contains("\n|"))
        return F.when(paragraph.startswith("<!--") | (F.size(rows) == 0), None).when(whole, paragraph).when(F.size(rows) == 1, single).when(S.algorithm_score(joined) >= ALONE, code_fence(joined)).otherwise(F.array_join(rows, " "))

    made = F.transform(F.transform(F.split(X.or_empty(text), "\n\n"), X.strip), one)
    return F.array_join(F.filter(made, lambda p: p.isNotNull()), "\n\n")


def merged_cells(data: Column) -> Column:
    """A cell matrix without columns that have no header (they go on with the one before) and rows whose first cell is empty (with the row before)."""
    header = F.get(data, 0)
    filled = lambda c: X.strip(X.or_empty(c)) != ""
    width = F.size(header)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: filled(F.get(header, i)))
    cell = lambda c: X.strip(F.regexp_replace(X.or_empty(c), r"<br>\s*", " "))
    whole = lambda s: F.regexp_replace(s, r"(\w)- (\w)", "$1$2")

    def merged(cols: Column) -> Column:
        until = lambda k: F.coalesce(F.get(cols, k + 1), width)
        row = lambda r: F.transform(cols, lambda c, k: F.array_join(F.filter(F.transform(F.slice(r, c + 1, until(k) - c), cell), lambda s: s != ""), " "))
        start = F.array().cast("array<array<string>>")

        def step(done: Column, r: Column) -> Column:
            last = F.element_at(done, -1)
            added = F.zip_with(last, r, lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.when(a != "", " ").otherwise(""), whole(b))))
            return F.when(F.get(r, 0) != "", F.concat(done, F.array(F.transform(r, whole)))).when(F.size(done) > 0, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(added))).otherwise(done)

        return F.aggregate(F.transform(data, row), start, step)

    return X.let(starts, lambda cols: F.when(F.size(cols) > 0, merged(cols)).otherwise(F.array().cast("array<array<string>>")))


def characteristics(pages: DataFrame, scan: int = 5) -> DataFrame:
    """One row for each document of pages (doc_id, page, text, images, math_fonts): what its first pages hold.

    The limit of pages is part of the operator: a quick scan. One shuffle by document, of counts.
    """
    first = pages.where(F.col("page") < scan)
    count = lambda *p: S.lines_like(F.col("text"), *p)
    rows = first.select("doc_id", F.length("text").alias("chars"), "images", "math_fonts", count(r"^\s*\|.*\|.*\|\s*$").alias("piped"), count(r"^    \S", r"def |class ").alias("code"))
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("scanned"), *[F.sum(c).alias(c) for c in ("chars", "images", "math_fonts", "piped", "code")])
    mean = F.col("chars") / F.greatest(F.col("scanned"), F.lit(1))
    out = sums.select("doc_id", "scanned", (F.col("piped") > 2).alias("has_tables"), (F.col("math_fonts") > 3).alias("has_formulas"), (F.col("code") > 5).alias("has_code_blocks"), (F.col("images") > 0).alias("has_images"), S.density(F.col("chars"), F.col("scanned")).alias("text_density"), (mean < 200).alias("is_scanned"))
    return out.withColumn("has_complex_layout", F.col("has_tables") | F.col("has_formulas") | F.col("has_images"))


def batch_summary(results: DataFrame, successes_only: bool) -> DataFrame:
    """Counts and sums of results (success, pages, words); sums over all rows, or over successful ones."""
    keep = F.col("success") if successes_only else F.lit(True)
    total = lambda c: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0))
    ok = F.count_if(F.col("success"))
    return results.agg(F.count("*").alias("total"), ok.alias("successful_count"), F.count_if(~F.col("success")).alias("failed_count"), total("pages").alias("total_pages"), total("words").alias("total_words"), (ok / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"))


def as_view(title: Column, url: Column, words: Column, content: Column, form: str) -> Column:
    """A response as json, markdown or plain text; parts that are null are left out."""
    if form == "json":
        return F.to_json(F.struct(title.alias("title"), url.alias("url"), words.alias("word_count"), content.alias("content")))
    head = [F.concat(F.lit("# "), title), F.concat(F.lit("- url: "), url), F.concat(F.lit("- words: "), words.cast("string"))] if form == "markdown" else [title, url]
    return F.array_join(F.filter(F.array(*head, content), lambda p: p.isNotNull()), "\n")


def allowed_by_robots(pages: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """pages (url, ...) that robots (domain, txt) lets the agent read; a domain without rules allows everything. Disallowed pages go."""

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, txt: pd.Series) -> pd.Series:
        known: dict[str, RobotFileParser] = {}

        def one(u: str | None, t: str | None) -> bool:
            if not t:
                return True
            if t not in known:
                known[t] = RobotFileParser()
                known[t].parse(t.splitlines())
            return known[t].can_fetch(agent, u or "")

        return pd.Series([one(u, t) for u, t in zip(url, txt, strict=True)])

    own = pages.withColumn("own_domain", X.domain(F.col("url")))
    ruled = own.join(robots.select(F.col("domain").alias("own_domain"), "txt"), "own_domain", "left")
    return ruled.where(allowed("url", "txt")).drop("own_domain", "txt")


def asset_id(kind: Column, page: Column, index: Column) -> Column:
    """A name that is the same on every run."""
    return F.concat_ws("_", kind, page.cast("string"), index.cast("string"))


def html_of_text(text: Column, title: Column, links: Column, most_links: int = 50) -> Column:
    """A plain page of a text's paragraphs and its first links (struct<url, text>); nothing is escaped."""
    body = F.transform(F.filter(F.transform(F.split(X.or_empty(text), "\n\n"), X.strip), lambda p: p != ""), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))
    anchors = F.transform(F.slice(links, 1, most_links), lambda x: F.concat(F.lit("<a href='"), x["url"], F.lit("'>"), F.coalesce(x["text"], x["url"]), F.lit("</a><br>")))
    none = F.array().cast("array<string>")
    head = F.when(X.or_empty(title) != "", F.array(F.concat(F.lit("<title>"), title, F.lit("</title>")))).otherwise(none)
    foot = F.when(F.size(anchors) > 0, F.concat(F.array(F.lit("<div class='links'>")), anchors, F.array(F.lit("</div>")))).otherwise(none)
    return F.array_join(F.concat(F.array(F.lit("<html><head>")), head, F.array(F.lit("</head><body>"), F.lit("<div class='main-content'>")), body, F.array(F.lit("</div>")), foot, F.array(F.lit("</body></html>"))), "\n")


def image_name(caption: Column, xref: Column, nearby: Column, pdf: Column, page: Column, index: Column) -> Column:
    """The first that is long enough of: slug of the caption (3), of the reference's name (2), of five words nearby (3); else a number."""
    from ..functions.latex import slug

    words = F.array_join(F.slice(X.words(nearby), 1, 5), " ")
    a, b, c = slug(X.or_empty(caption)), slug(X.or_empty(xref)), slug(words)
    number = F.concat(pdf, F.lit("-p"), page.cast("string"), F.lit("-"), index.cast("string"))
    return F.coalesce(F.when(F.length(a) >= 3, a), F.when(F.length(b) >= 2, b), F.when(F.length(c) >= 3, c), number)

