"""I-Match fingerprints over randomised lexicon subsets. DataFrame operations only.

The lexicon are the terms whose document frequency lies in a band: in LOW of all documents at least, in HIGH at most. A document
has no more terms in it than it has words, so the lexicon holds at most (mean distinct terms) / LOW terms, however many documents
there are; it goes to the tasks as one value. A document's distinct lexicon terms are sorted, and hashed once for each of SUBSETS
random subsets of the lexicon, which keep between 1/8 and 1/2048 of it: an edit spoils the dense subsets first and
the sparse ones last. Two fingerprints are as like as the share of their non-empty slots that agree, at the rate where
that is most: long texts agree in sparse subsets, and of short texts only the dense ones hold anything.

A document with fewer than FEW lexicon terms is filled up to FEW with others of its terms, those with the smallest hashes: an edit that brings a
lexicon term or takes one away exchanges one term, whatever their number. null text counts as empty; texts without any term have the
empty fingerprint. Equal texts have equal fingerprints. Documents in order are those by doc_id (null first), then by text hash;
the one after the last is the first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .pii import let

LOW, HIGH = 1 / 2000, 1 / 10
FEW = 8
#: (bits that a term's hash must have, first bit, number of subsets)
RATES = ((3, 0, 6), (5, 3, 12), (7, 8, 12), (9, 15, 12), (11, 24, 6))
SUBSETS = sum(n for _, _, n in RATES)
EMPTY = "-" * 8
ENOUGH = 4
#: Places of the lexicon's hash table.
PLACES = 1 << 14
#: Fine ranges of the order for each range that is dealt out.
SLICES = 16


def terms(text: Column) -> Column:
    """Distinct terms of a text, as 64-bit hashes: runs of letters and digits in lower case."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(h): the terms of the band."""
    n = docs.count()
    least, most = max(2, -(-int(n * low * 1000) // 1000)), max(2, int(n * high))
    seen = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return written(seen.where(F.col("df").between(least, most)).select("h"), "lexicon")


def _table(words: DataFrame) -> Column:
    """The lexicon as one array of PLACES short arrays, by the low bits of the hash."""
    spark = words.sparkSession
    place = F.pmod("h", F.lit(PLACES)).cast("int")
    cells = words.groupBy(place.alias("place")).agg(F.collect_list("h").alias("hs"))
    every = spark.range(PLACES).select(F.col("id").cast("int").alias("place")).join(cells, "place", "left").select("place", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "hs"))), lambda c: c["hs"]).alias("cells")).scalar()


def _slots(found: Column, bits: int, first: int, n: int) -> Column:
    """The slots of one rate. Sparse subsets are cut out of the few terms that are in any of them."""
    field = lambda h: F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << bits) - 1))

    def slot(some: Column, value: int) -> Column:
        mine = F.filter(some, lambda h: field(h) == value)
        code = lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
        return let(mine, lambda x: F.when(F.size(x) > 0, code(x)).otherwise(F.lit(EMPTY)))

    return let(F.filter(found, lambda h: field(h) < n), lambda some: F.concat(*[slot(some, v) for v in range(n)]))


def fingerprint(text: Column, table: Column) -> Column:
    def band(cells: Column) -> Column:
        def chosen(all_: Column) -> Column:
            inside = F.filter(all_, lambda h: F.array_contains(F.get(cells, F.pmod(h, F.lit(PLACES)).cast("int")), h))
            filled = lambda x: F.concat(x, F.slice(F.array_sort(F.array_except(all_, x)), F.lit(1), F.lit(FEW) - F.size(x)))
            return let(inside, lambda x: F.array_sort(F.when(F.size(x) < FEW, filled(x)).otherwise(x)))

        return let(terms(text), chosen)

    slots = lambda found: F.concat(*[_slots(found, *rate) for rate in RATES])
    return let(let(table, band), slots)


def likeness(a: Column, b: Column) -> Column:
    """The share of slots, of those that are not empty in both, that agree, at the best rate with ENOUGH such slots, or else of all; 1 for equal fingerprints."""
    part = lambda x, i: F.substring(x, i * 8 + 1, F.lit(8))

    def share(first: int, n: int, least: int) -> Column:
        slots = F.sequence(F.lit(first), F.lit(first + n - 1))
        used = F.size(F.filter(slots, lambda i: (part(a, i) != EMPTY) | (part(b, i) != EMPTY)))
        same = F.size(F.filter(slots, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != EMPTY)))
        return F.when(used >= least, same / used)

    starts = [sum(n for _, _, n in RATES[:k]) for k in range(len(RATES))]
    best = F.greatest(*[share(s, n, ENOUGH) for s, (_, _, n) in zip(starts, RATES, strict=True)])
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(best, share(0, SUBSETS, 1), F.lit(0.0)))


def with_next(df: DataFrame, column: str, out: str, size: Column | None = None) -> DataFrame:
    """df (with ord and tie, its order) and the value of `column` in the row that follows; after the last comes the first.

    Rows are dealt out by ranges of ord of about equal size (of a row: `size`, or 1): SLICES fine ranges for each one wanted, whose borders are approximate quantiles,
    are put together by their sums. What follows a range's last row is the first row of the next range: one row for each range is read again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = SLICES * parts
    shares = F.array(*[F.lit((i + 1) / fine) for i in range(fine - 1)])
    borders = sorted(set(df.agg(F.percentile_approx("ord", shares, F.lit(10 * fine))).first()[0] or []))
    # rows up to a border lie in its range; the table of borders is as long as there are ranges
    below = lambda x, last: F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(borders)).bit_length() + 1)), F.struct(F.lit(0).alias("a"), F.lit(len(borders)).alias("b")), lambda s, _: _halved(s, x, last), lambda s: s["a"])
    slice_ = let(F.from_json(F.lit(json.dumps(borders)), "array<bigint>"), lambda listed: below(listed, F.col("ord")))
    sizes = df.withColumn("slice", slice_).groupBy("slice").agg(F.sum(F.lit(1) if size is None else size).alias("n"), F.min("ord").alias("ord"))
    sizes = sorted((r["slice"], r["n"], r["ord"]) for r in sizes.collect())  # SLICES rows for each range
    total, done, ranges, firsts = sum(n for _, n, _ in sizes), 0, [], []
    for s, n, o in sizes:
        k = min(parts - 1, done * parts // max(1, total))
        if not ranges or ranges[-1][1] != k:
            firsts.append((k, o))
        ranges.append((s, k))
        done += n
    of_slice = dict(ranges)
    listed = F.split(F.lit(",".join(str(of_slice.get(s, 0)) for s in range(len(borders) + 1))), ",").cast("array<int>")
    df = df.withColumn("slice", slice_).withColumn("range", F.get(listed, F.col("slice"))).drop("slice")
    after = [{"range": r, "ord": firsts[(k + 1) % len(firsts)][1]} for k, (r, _) in enumerate(firsts)]
    step = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(after)), "array<struct<range:int,ord:bigint>>")))
    heads = df.where(F.col("ord").isin([o for _, o in firsts])).groupBy("ord").agg(F.min(F.struct("tie", column))[column].alias(column))
    # the row after a range's last is dealt out with the range, so that whole texts are dealt out once and joined with nothing
    heads = step.join(heads, "ord").select("range", column, F.lit(True).alias("head"))
    rows = df.withColumn("head", F.lit(False)).unionByName(heads, allowMissingColumns=True).repartitionById(parts, F.col("range"))
    follows = F.lead(column).over(Window.partitionBy("range").orderBy("head", "ord", "tie"))
    return rows.withColumn(out, follows).where(~F.col("head")).drop("range", "head")


def _halved(s: Column, listed: Column, value: Column) -> Column:
    """One step of a search for the number of borders that are below value, between a and b."""
    mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
    under = F.get(listed, mid) < value
    return F.when(s["a"] >= s["b"], s).when(under, F.struct((mid + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), mid.alias("b")))


def edited(text: Column, follows: Column) -> Column:
    """The last quarter of a text replaced by the beginning of the one that follows."""
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(follows, F.lit(1), k))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """docs with `fingerprint` of docs.text (a column of that name is replaced)."""
    words = lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), low, high)
    return docs.withColumn("fingerprint", fingerprint(F.coalesce("text", F.lit("")), _table(words)))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", body.alias("text"))
    words = lexicon(rows)
    ordered = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("ord"), F.xxhash64("text").alias("tie"), "text")
    both = with_next(ordered, "text", "next_text", F.octet_length("text") + 64).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    both = both.select("doc_id", "ord", "tie", "text", "edit").withColumn("table", _table(words))
    prints = both.select("doc_id", "ord", "tie", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"), fingerprint(F.col("text"), F.col("table")).alias("fingerprint"), fingerprint(F.col("edit"), F.col("table")).alias("edited_fingerprint"))
    out = with_next(written(prints, "fingerprints"), "fingerprint", "next_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
