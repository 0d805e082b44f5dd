"""Competing extractions: gates, fallback, competition, supplements, merges.

Candidates are rows (doc_id, engine, rank, success, content); a document's candidates are few, so each choice is one aggregation by
document. Ties go to the better rank. Nothing is chosen by the order in which tools happened to finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X

# What an engine's name adds to its score, twice.
PRIORITY = {"docling": 10, "mineru": 8, "marker": 6, "pymupdf": 4}
#: How many times the counters of the best one the next one must have to supplement it.
MORE = 1.5

_TABLE = r"(?m)(\|[^\n]+\|\n\|[-| :]+\|\n(?:\|[^\n]+\|\n)*)"
_BLOCK_FORMULA = r"\$\$[\s\S]+?\$\$"
_CODE = r"```\w*\n[\s\S]+?\n```"


def priority(engine: Column) -> Column:
    return F.coalesce(*[F.when(engine.contains(name), F.lit(p)) for name, p in PRIORITY.items()], F.lit(0))


def gated(tools: DataFrame, gates: dict[str, bool]) -> DataFrame:
    """tools (engine, enabled, rank, ...) whose gate is open, enabled, with a rank; an engine without a gate stays."""
    closed = [name for name, there in gates.items() if not there]
    kept = tools.where(~F.col("engine").isin(closed)) if closed else tools
    return kept.where(F.coalesce(F.col("enabled"), F.lit(True))).withColumn("rank", F.coalesce("rank", F.lit(999)))


def fallback(candidates: DataFrame) -> DataFrame:
    """The first success by rank of each document; null engine and an error where none succeeded."""
    best = F.min_by(F.struct("engine", "content"), F.when(F.col("success"), F.struct("rank", "engine")))
    out = candidates.groupBy("doc_id").agg(best.alias("best"))
    return out.select("doc_id", "best.engine", "best.content", F.when(F.col("best.engine").isNull(), F.lit("all tools failed")).alias("error"))


def compete(candidates: DataFrame, most: int = 3) -> DataFrame:
    """The best content of each document, of the `most` first tools by rank: score plus twice the priority; empty content never wins."""
    first = candidates.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "engine"))).where(F.col("place") <= most)
    fit = first.where(F.col("success") & (X.or_empty(F.col("content")) != ""))
    scored = fit.withColumn("score", S.heuristic_score(F.col("content")) + 2 * priority(F.col("engine")))
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("engine", "content", "score"), F.struct("score", (-F.col("rank")).alias("r"))).alias("b")).select("doc_id", "b.engine", "b.content", "b.score")


def synthesize(candidates: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """doc_id, engine, content, other, other_content, supplements: the best, the next, and in what the next one has far more.

    weights gives a plan's priority for engines; others have none.
    """
    weights = weights or {}
    extra = F.coalesce(*[F.when(F.col("engine") == n, F.lit(w)) for n, w in weights.items()], F.lit(0))
    found = S.counters(F.col("content"))
    kept = ("table_lines", "formula_block_count", "formula_inline_count", "code_fence_count")
    scored = candidates.where("success").select("doc_id", "engine", "rank", "content", (S.weighted(found.__getitem__) + 2 * extra).alias("score"), *[found[k].alias(k) for k in kept])
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "rank")
    both = scored.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead(F.struct("engine", "content", *kept)).over(w)).where("place = 1")
    formulas = lambda p: F.col(f"{p}formula_block_count") + F.col(f"{p}formula_inline_count")
    tests = (("tables", F.col("next.table_lines") > F.col("table_lines") * MORE), ("formulas", formulas("next.") > formulas("") * MORE), ("code_blocks", F.col("next.code_fence_count") > F.col("code_fence_count") * MORE))
    supplements = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda s: s.isNotNull())
    return both.select("doc_id", "engine", "content", F.col("next.engine").alias("other"), F.col("next.content").alias("other_content"), supplements.alias("supplements"), "score")


def _appended(first: Column, more: Column, what: str) -> Column:
    return F.when(F.size(more) > 0, F.concat(first, F.lit(f"\n\n---\n\n<!-- {what} of another engine -->\n\n"), F.array_join(more, "\n\n"))).otherwise(first)


def merge_tables(first: Column, second: Column) -> Column:
    """first, and the tables of second whose header line is in none of first's."""
    own = F.regexp_extract_all(first, F.lit(_TABLE), F.lit(0))
    head = lambda t: X.strip(F.get(F.split(t, "\n"), 0))
    new = F.filter(F.regexp_extract_all(second, F.lit(_TABLE), F.lit(0)), lambda t: ~F.exists(own, lambda o: o.contains(head(t))))
    return _appended(first, new, "tables")


def merge_formulas(first: Column, second: Column, most: int = 10) -> Column:
    """first, and second's block formulas if it has over twice as many and first fewer than three."""
    own, other = (F.regexp_extract_all(x, F.lit(_BLOCK_FORMULA), F.lit(0)) for x in (first, second))
    wanted = (F.size(other) > F.size(own) * 2) & (F.size(own) < 3)
    return F.when(wanted, _appended(first, F.slice(other, 1, most), "formulas")).otherwise(first)


def merge_code(first: Column, second: Column, most: int = 20) -> Column:
    """first, and second's code blocks that begin like none of first's, if it has half as many again."""
    own, other = (F.regexp_extract_all(x, F.lit(_CODE), F.lit(0)) for x in (first, second))
    new = F.filter(other, lambda b: ~F.exists(own, lambda o: o.contains(F.substring(b, 1, 50))))
    return F.when(F.size(other) > F.size(own) * MORE, _appended(first, F.slice(new, 1, most), "code")).otherwise(first)


def merged(first: Column, second: Column, supplements: Column) -> Column:
    second = X.or_empty(second)
    out = first
    for name, merge in (("tables", merge_tables), ("formulas", merge_formulas), ("code_blocks", merge_code)):
        out = _if_listed(out, second, supplements, name, merge)
    return out


def _if_listed(out: Column, second: Column, supplements: Column, name: str, merge) -> Column:
    return X.let(out, lambda x: F.when(F.array_contains(supplements, name), merge(x, second)).otherwise(x))
