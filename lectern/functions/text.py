"""String functions over text and URLs: Column in, Column out.

Java's \\s and \\w are ASCII unless (?U) asks for Unicode; a null input counts as an empty text unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of addresses and phone numbers, in the order in which their finds are listed.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (r"\b\d{3}-\d{3}-\d{4}\b", r"\b\(\d{3}\)\s*\d{3}-\d{4}\b", r"\b\d{3}\.\d{3}\.\d{4}\b", r"\b\d{10}\b")

_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def bigint(x: Column) -> Column:
    return x.cast("bigint")


def sums_before(numbers: Column, block: int = 256) -> Column:
    """For each number the sum of those before it; by blocks, so that a long array takes no quadratic time."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    of = lambda i: F.floor(i / block).cast("int")

    def placed(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), of(F.size(a) - 1)), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        earlier = let(blocks, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
        return let(earlier, lambda t: F.transform(a, lambda _, i: F.get(t, of(i)) + total(F.slice(a, of(i) * block + 1, i % block))))

    return let(numbers, lambda a: F.when(F.size(a) > 0, placed(a)).otherwise(F.array().cast("array<int>")))


def lines(x: Column) -> Column:
    return F.split(or_empty(x), "\n", -1)


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(or_empty(x), r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return bigint(F.size(words(x)))


def clean_text(x: Column) -> Column:
    """White space to single blanks, control characters dropped, trimmed."""
    flat = F.regexp_replace(or_empty(x), r"(?U)\s+", " ")
    return strip(F.regexp_replace(flat, r"[\x00-\x1f\x7f-\x9f]", ""))


def emails(x: Column) -> Column:
    return F.regexp_extract_all(or_empty(x), F.lit(EMAIL), F.lit(0))


def phone_numbers(x: Column) -> Column:
    """Finds of each pattern in turn."""
    return F.concat(*[F.regexp_extract_all(or_empty(x), F.lit(p), F.lit(0)) for p in PHONES])


def url_part(url: Column, part: str) -> Column:
    """scheme, authority (user and port included), path, query or fragment; empty where absent. Never fails."""
    place = ("scheme", "authority", "path", "query", "fragment").index(part) + 1
    return F.regexp_extract(or_empty(url), _URL, place)


def is_valid_url(url: Column) -> Column:
    return (url_part(url, "scheme") != "") & (url_part(url, "authority") != "")


def validate_url(url: Column) -> Column:
    """null, or what is wrong."""
    return F.when(~is_valid_url(url), F.lit("Invalid URL format"))


def domain(url: Column) -> Column:
    return url_part(url, "authority")


def normalize_url(url: Column) -> Column:
    """With a scheme, without fragment."""
    full = F.when(or_empty(url).rlike("^https?://"), or_empty(url)).otherwise(F.concat(F.lit("https://"), or_empty(url)))
    query = url_part(full, "query")
    return F.concat(url_part(full, "scheme"), F.lit("://"), url_part(full, "authority"), url_part(full, "path"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_web_source(source: Column) -> Column:
    """Whether a PDF is to be fetched rather than opened."""
    return F.lower(url_part(source, "scheme")).isin("http", "https")


def absolute_url(href: Column, base: Column) -> Column:
    """href resolved against base: absolute, protocol-relative, rooted, query, fragment and relative references, with dot segments."""
    root = F.concat(url_part(base, "scheme"), F.lit("://"), url_part(base, "authority"))
    folder = F.regexp_replace(url_part(base, "path"), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    kept = F.aggregate(
        F.slice(F.split(joined, "/"), 2, 1 << 20),
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    dotted = joined.rlike(r"/\.{1,2}$")
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(dotted & (F.size(kept) > 0), "/").otherwise(""))
    own = F.when(url_part(base, "query") != "", F.concat(F.lit("?"), url_part(base, "query"))).otherwise("")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href == "", F.concat(root, url_part(base, "path"), own))
        .when(href.startswith("//"), F.concat(url_part(base, "scheme"), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(root, url_part(base, "path"), own, href))
        .when(href.startswith("?"), F.concat(root, url_part(base, "path"), href))
        .otherwise(F.concat(root, resolved, rest))
    )


def page_range_error(range_: Column) -> Column:
    """null if an array of (start, end) is fit, or empty; else what is wrong."""
    a, b = F.get(range_, 0), F.get(range_, 1)
    return (
        F.when(range_.isNull() | (F.size(range_) == 0), None)
        .when(F.size(range_) != 2, F.lit("page range takes two numbers"))
        .when((a < 0) | (b < 0), F.lit("page numbers must not be negative"))
        .when(a >= b, F.lit("the first page must come before the last"))
    )


def clamp_range(range_: Column, pages: Column) -> Column:
    """(start, end) within the document; all of it where no range is given."""
    return F.struct(F.greatest(F.lit(0), F.coalesce(F.get(range_, 0), F.lit(0))).alias("start"), F.least(pages, F.coalesce(F.get(range_, 1), pages)).alias("end"))


def title_like(line: Column) -> Column:
    """Eight words at most, over 60 % of them capitalised."""
    w = words(line)
    return (F.size(w) <= 8) & (F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}"))) > F.size(w) * 0.6)


def parse_pixels(x: Column) -> Column:
    return strip(F.replace(x, F.lit("px"), F.lit(""))).try_cast("int")


def first_seen(values: Column) -> Column:
    """Distinct values, in the order in which they first occur."""
    return F.array_distinct(values)


def padded(row: Column, width: Column) -> Column:
    """A row of cells with empty ones up to a width."""
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def reduction(before: Column, after: Column) -> Column:
    return F.round(1 - F.length(after) / F.greatest(F.length(before), F.lit(1)), 3)
