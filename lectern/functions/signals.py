"""Counters and scores over Markdown and plain text: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bigint, let, lines, or_empty, strip, word_count

# What counts as a formula, image, link or line of a kind.
INLINE_FORMULA = r"(?<!\$)\$(?!\$)([^$]+?)\$(?!\$)"
BLOCK_FORMULA = r"\$\$[\s\S]+?\$\$"
IMAGE, LINK_REFERENCE, IMAGE_REFERENCE = r"!\[.*?\]\(.*?\)", r"\[([^\]]*)\]\(([^)]+)\)", r"!\[([^\]]*)\]\(([^)]+)\)"
HEADING_LINE, TABLE_LINE, LIST_LINES = r"^#{1,6}\s+", r"^\s*\|", (r"^\s*[-*+]\s+", r"^\s*\d+\.\s+")

#: The counters of a text, and what each adds to its score.
WEIGHTS = {"word_count": 0.001, "heading_count": 5, "table_lines": 3, "formula_block_count": 10, "formula_inline_count": 2, "code_fence_count": 5, "image_count": 3}

# Signs of pseudo code.
ALGORITHM_TITLE = r"(?i)^(?U:\s*)(?:Algorithm|Procedure|Function|Subroutine|Listing)\s+\d+"
ALGORITHM_HEADER = r"(?im)^(?:Require|Ensure|Input|Output|Precondition|Postcondition)\s*:"
ALGORITHM_KEYWORD = r"(?i)(?:^|\s)(?:if\b|then\b|else\b|end\s+(?:if|for|while|function|procedure|loop)\b|for\s+(?:each|all)?\b|while\b|\bdo\b|repeat\b|until\b|return\b|function\b|procedure\b|begin\b|call\b)"
ALGORITHM_SIGNS = "[←→≠≤≥∅▷◃∈∉∀∃⊂⊃∪∩∧∨≜≝≐⊕⊗]"
NUMBERED = r"^(?U:\s*)\d+\s*:\s+\S"
CAPTIONS = (r"(?i)^(?:Figure|Fig\.?|Image|Diagram|Chart|Graph|Illustration)\s*\d+", r"^(?:图|插图|示意图|架构图|流程图)\s*\d+", r"(?i)^(?:Table|表)\s*\d+")


def count_of(x: Column, pattern: str) -> Column:
    return bigint(F.regexp_count(x, F.lit(pattern)))


def lines_like(x: Column, *patterns: str) -> Column:
    return bigint(F.size(F.filter(lines(x), lambda s: F.lit(False) if not patterns else _any(s, patterns))))


def _any(s: Column, patterns: tuple[str, ...]) -> Column:
    out = s.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | s.rlike(p)
    return out


def counters(x: Column) -> dict[str, Column]:
    """Name to counter; an empty text has zeros."""
    x = or_empty(x)
    return {
        "word_count": word_count(x),
        "char_count": bigint(F.length(x)),
        "line_count": F.when(x == "", F.lit(0).cast("bigint")).otherwise(bigint(F.size(lines(x)))),
        "heading_count": lines_like(x, HEADING_LINE),
        "table_lines": lines_like(x, TABLE_LINE),
        "formula_block_count": count_of(x, BLOCK_FORMULA),
        "formula_inline_count": count_of(x, INLINE_FORMULA),
        "code_fence_count": bigint(F.floor(count_of(x, "```") / 2)),
        "image_count": count_of(x, IMAGE),
        "list_count": lines_like(x, *LIST_LINES),
    }


def quality_signals(x: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in counters(x).items()], (or_empty(x) == "").alias("is_empty"))


def weighted(value) -> Column:
    """The score of counters; value(name) gives each."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        out = out + value(name) * F.lit(float(weight))
    return out


def heuristic_score(x: Column) -> Column:
    found = counters(x)
    return weighted(found.__getitem__)


def is_caption(x: Column) -> Column:
    return _any(strip(F.get(F.split(strip(or_empty(x)), "\n"), 0)), CAPTIONS)


def algorithm_score(x: Column) -> Column:
    """Points for the signs of pseudo code, less what speaks for prose; 0 for Markdown tables. One pass over the lines."""
    x = or_empty(x)
    one = lambda test: test.cast("int")
    zero = F.struct(*[F.lit(0).alias(c) for c in ("n", "numbered", "keywords", "chars")])

    def add(a: Column, s: Column) -> Column:
        more = F.struct((a["n"] + 1).alias("n"), (a["numbered"] + one(s.rlike(NUMBERED))).alias("numbered"), (a["keywords"] + one(s.rlike(ALGORITHM_KEYWORD))).alias("keywords"), (a["chars"] + F.length(s)).alias("chars"))
        return F.when(s.rlike(r"(?U)\S"), more).otherwise(a)

    found = F.struct(F.aggregate(lines(x), zero, add).alias("lines"), x.rlike(ALGORITHM_TITLE).alias("titled"), x.rlike(ALGORITHM_HEADER).alias("headed"), F.regexp_count(x, F.lit(ALGORITHM_SIGNS)).alias("signs"), x.rlike(r"(?m)^\|[\s-]+\|").alias("table"))

    def score(f: Column) -> Column:
        n, points = f["lines"]["n"], lambda test, p: F.when(test, p).otherwise(0)
        many = f["signs"] >= 2
        out = points(f["titled"], 5) + points(f["headed"], 3) + F.least(f["lines"]["numbered"], F.lit(5)) + F.least(f["lines"]["keywords"], F.lit(5)) + points(many, 2)
        out = out - points(f["lines"]["chars"] / F.greatest(n, F.lit(1)) > 120, 3) - points((n < 3) & ~f["titled"], 2) - points(~(f["titled"] | f["headed"] | (f["lines"]["numbered"] >= 2) | many), 2)
        return bigint(F.when((n == 0) | f["table"], 0).otherwise(out))

    return let(found, score)


def is_algorithm(x: Column, threshold: int = 5) -> Column:
    return or_empty(x).rlike(r"(?U)\S") & (algorithm_score(x) >= threshold)


def has_markdown(x: Column) -> Column:
    """A heading, or two of six other marks (bold counts as italic too)."""
    x = or_empty(x)
    heading = x.rlike(r"(?m)^#{1,6}\s+")
    marks = (heading, x.rlike(r"(?m)^\s*[-*+]\s+"), x.contains("**") | x.contains("__"), x.contains("*") | x.contains("_"), x.contains("[") & x.contains("]("), x.contains("`"))
    return heading | (sum((m.cast("int") for m in marks[1:]), marks[0].cast("int")) >= 2)


def link_count(x: Column) -> Column:
    """Links and image references alike."""
    return count_of(or_empty(x), LINK_REFERENCE)


def image_count(x: Column) -> Column:
    return count_of(or_empty(x), IMAGE_REFERENCE)


def page_metadata(url: Column, title: Column, markdown: Column) -> dict[str, Column]:
    from .text import domain

    return {"title": title, "url": url, "domain": domain(url), "word_count": word_count(markdown), "character_count": bigint(F.length(markdown)), "link_count": link_count(markdown), "image_ref_count": image_count(markdown)}


def density(chars: Column, pages: Column) -> Column:
    """How much text a page of a document has."""
    mean = chars / F.greatest(pages, F.lit(1))
    return F.when(mean < 200, "sparse").when(mean > 2000, "dense").otherwise("normal")
