"""Tables in plain text: rows, cells, a quality gate, Markdown. Array expressions on lines; one pass per document, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigint, let, lines, or_empty, strip, words

# Function words that tell prose from cells.
STOP_WORDS = (
    "the a an of in to for with on at by from is are was were be been being have has had do does did will would could should "
    "may might can shall that this these those it its and or but not no nor as if than then when where how what which who whom whose "
    "的 是 在 和 了 与 等 中 对 为 以 及 或 其 被 从 把 比 让 向 也 都 而 将 于 之 不 有 这 那"
).split()
_RULE = r"^[\s|\-]+$"


def cells(line: Column) -> Column:
    """The filled cells of a row: by pipe, else tab, else two blanks or more."""
    by = lambda p: F.filter(F.transform(F.split(line, p, -1), strip), lambda c: c != "")
    return F.when(line.contains("|"), by(r"\|")).when(line.contains("\t"), by("\t")).otherwise(by(" {2,}"))


def _spaced(line: Column) -> Column:
    """Three segments or more between wide gaps, none of which is most of the line, and few function words."""
    parts = F.filter(F.transform(F.split(line, " {2,}"), strip), lambda s: s != "")
    sizes = F.transform(parts, F.length)
    total = F.aggregate(sizes, F.lit(0), lambda a, b: a + b)
    said = words(F.lower(line))
    stops = F.size(F.filter(said, lambda w: w.isin(*STOP_WORDS)))
    return line.rlike(" {2,}") & (F.size(parts) >= 3) & (F.array_max(sizes) / F.greatest(total, F.lit(1)) <= 0.65) & (stops / F.greatest(F.size(said), F.lit(1)) <= 0.25)


def is_row(line: Column) -> Column:
    x = strip(or_empty(line))
    count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return (count("\t") >= 2) | (count("|") >= 2) | F.coalesce(_spaced(x), F.lit(False))


def consistent(rows: Column) -> Column:
    """Whether 30 % of the rows at most (or one) differ from the usual number of cells."""
    kept = F.filter(F.transform(rows, strip), lambda r: (r != "") & ~r.rlike(_RULE))
    width = lambda r: F.when(r.contains("|"), F.size(cells(r))).when(r.contains("\t"), F.size(F.split(r, "\t", -1))).otherwise(F.size(cells(r)))
    widths = F.transform(kept, width)
    deviating = lambda w: F.size(w) - F.array_max(F.transform(F.array_distinct(w), lambda a: F.size(F.filter(w, lambda b: a == b))))
    return let(widths, lambda w: F.coalesce((F.size(w) > 0) & (deviating(w) <= F.greatest(F.lit(1.0), F.size(w) * 0.3)), F.lit(False)))


def cell_matrix(rows: Column) -> Column:
    """Rows of filled cells, without rules and empty rows."""
    kept = F.filter(F.transform(rows, strip), lambda r: (r != "") & ~r.rlike(_RULE))
    return F.filter(F.transform(kept, cells), lambda r: F.size(r) > 0)


def quality(data: Column, least_filled: float = 0.4, weak_share: float = 0.5, distinct: int = 3) -> Column:
    """struct<passed, reason, rows, cols, occupancy, weak_cols, unique_cells> of a matrix of cells; reasons in a fixed order."""
    return let(data, lambda d: _quality(d, least_filled, weak_share, distinct))


def _quality(data: Column, least_filled: float, weak_share: float, distinct: int) -> Column:
    rows, cols = F.size(data), F.array_max(F.transform(data, F.size))
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    filled = F.filter(F.transform(F.flatten(data), text), lambda c: c != "")
    occupancy = F.size(filled) / (rows * cols)
    column = lambda i: F.size(F.filter(data, lambda r: text(F.get(r, i)) != "")) / rows
    weak = F.size(F.filter(F.sequence(F.lit(0), cols - 1), lambda i: column(i) < 0.4))
    unique = F.size(F.array_distinct(filled))

    def broken(row: Column) -> Column:
        """Neighbours in a row, and those where a word seems to go on."""
        inside = F.transform(F.filter(row, lambda c: c.isNotNull()), text)
        pairs = F.filter(F.transform(inside, lambda c, i: F.struct(c.alias("a"), F.get(inside, i + 1).alias("b"))), lambda p: (p["a"] != "") & (F.coalesce(p["b"], F.lit("")) != ""))
        return F.struct(F.size(pairs).alias("n"), F.size(F.filter(pairs, lambda p: p["a"].rlike(r"\p{L}$") & p["b"].rlike(r"^\p{Ll}"))).alias("k"))

    sums = F.aggregate(F.transform(data, broken), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["k"] + b["k"]).alias("k")))
    prose = ((rows > 20) & cols.between(2, 5)) | ((sums["n"] > 0) & (sums["k"] / F.greatest(sums["n"], F.lit(1)) > 0.3))
    reason = (
        F.when(F.coalesce(rows, F.lit(0)) <= 0, "empty")
        .when(rows < 2, "too_few_rows")
        .when(cols < 2, "too_few_cols")
        .when(occupancy < least_filled, "low_occupancy")
        .when(weak > F.floor(cols * weak_share), "too_many_weak_cols")
        .when(unique < distinct, "low_uniqueness")
        .when(prose, "prose_like_cells")
        .otherwise("pass")
    )
    fit = (rows >= 2) & (cols >= 2)
    return F.struct((reason == "pass").alias("passed"), reason.alias("reason"), bigint(rows).alias("rows"), bigint(cols).alias("cols"), F.when(fit, F.round(occupancy, 3)).alias("occupancy"), F.when(fit, bigint(weak)).alias("weak_cols"), F.when(fit, bigint(unique)).alias("unique_cells"))


def _row(values: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))


def _with_rule(rows: Column, width: Column) -> Column:
    rule = _row(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.when(F.size(rows) >= 2, F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows)))).otherwise(rows), "\n")


def markdown_of_lines(rows: Column) -> Column:
    """Markdown of text rows; the first row says what parts the cells."""
    first = F.get(rows, 0)
    piped = F.transform(F.filter(rows, lambda r: ~strip(r).rlike(_RULE)), lambda r: F.filter(F.transform(F.split(r, r"\|", -1), strip), lambda c: c != ""))
    tabbed = F.transform(rows, lambda r: F.transform(F.split(r, "\t", -1), strip))
    spaced = F.filter(F.transform(rows, lambda r: F.split(strip(r), r"\s{2,}", -1)), lambda r: F.size(r) > 1)
    chosen = F.when(first.contains("|"), piped).when(first.contains("\t"), tabbed).otherwise(spaced)
    shown = F.transform(chosen, _row)
    return _with_rule(shown, F.size(F.split(F.get(shown, 0), r"\|", -1)) - 2)


def markdown_of_cells(data: Column) -> Column:
    """Markdown of a matrix: rows as wide as the first, pipes escaped below the header; empty with fewer than two rows."""
    width = F.size(F.get(data, 0))
    body = F.transform(F.slice(data, F.lit(2), F.greatest(F.size(data), F.lit(1))), lambda r: F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width), lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))
    rows = F.concat(F.array(F.get(data, 0)), body)
    return F.when(F.size(data) >= 2, _with_rule(F.transform(rows, _row), width)).otherwise("")


def headers(line: Column) -> Column:
    return F.when(line.contains("|"), F.filter(F.transform(F.split(line, r"\|", -1), strip), lambda c: c != "")).when(line.contains("\t"), F.transform(F.split(line, "\t", -1), strip)).otherwise(F.split(strip(line), r"\s{2,}", -1))


def runs(text: Column) -> Column:
    """Maximal runs of table rows, in order, as arrays of trimmed lines: other lines become empty, and two line breaks part the runs. Linear in the lines."""
    rows = F.array_join(F.transform(lines(text), lambda s: F.when(is_row(s), strip(s)).otherwise("")), "\n")
    parts = F.filter(F.split(F.btrim(rows, F.lit("\n")), r"\n\n+", -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.split(p, "\n", -1))


def tables_in_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, markdown, rows, columns, headers) of the tables that pass the gate."""
    found = docs.select(key, F.posexplode(runs(F.col(text))).alias("run", "rows_")).where(F.size("rows_") >= 2)
    found = found.where(consistent(F.col("rows_"))).withColumn("gate", quality(cell_matrix(F.col("rows_")))).where("gate.passed")
    first = F.get("rows_", 0)
    data = F.size(F.filter("rows_", lambda r: ~r.rlike(_RULE)))
    piped = first.contains("|")
    shape = found.select(key, "run", markdown_of_lines(F.col("rows_")).alias("markdown"), bigint(F.when(piped, data).otherwise(F.size("rows_"))).alias("rows"), bigint(F.when(piped, F.size(headers(first))).otherwise(F.size(F.split(first, "\t", -1)))).alias("columns"), headers(first).alias("headers"))
    from pyspark.sql import Window

    return shape.withColumn("table_no", F.row_number().over(Window.partitionBy(key).orderBy("run")) - 1).drop("run")
