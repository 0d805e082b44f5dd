"""Personal data: plain formats as seeds, and contexts learned from them by bootstrapping. DataFrame operations only.

Base entities (e-mail, IP, card, phone) are found by pattern. Every identifier-like string of the corpus is an instance: a word with a digit or @, and the
groups of digits that follow it after one blank each. Its lexical patterns are the words around it (one before, two before, one after, one on either side).
Rounds alternate over that graph: a pattern is as confident as the share of its distinct instances that are known to be of one kind, an instance
as sure as its patterns make it together; instances over the threshold are known in the next round, until a round finds none. Known instances
that no base format covers are added, wherever they stand.

null text counts as empty. Spans are code points, end exclusive. Repeated rows each have their own result, and count
once in every score, as scores go by distinct instances. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")

# The formats, written so that Java matches them in linear time and without recursion: a run is entered at its start or where the last
# match ended, and repetitions are possessive where what follows can't be part of them.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have to be searched for a kind at all.
_HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().-]*+(?!\S))*+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def offsets(lengths: Column) -> Column:
    """Running sums before each element, of an array that isn't empty; by blocks, so that long arrays don't take quadratic time."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), block(F.size(lengths) - 1)), lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    before = let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b))))
    return let(before, lambda s: F.transform(F.sequence(F.lit(0), F.size(lengths) - 1), lambda i: F.get(s, block(i)) + total(F.slice(lengths, block(i) * BLOCK + 1, i % BLOCK))))


SPANS = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"


def matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: start, end, value, and the text on either side up to the next match."""

    def placed(s: Column) -> Column:
        between, found = s["between"], s["found"]
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: (F.length(a) + F.length(b)).cast("long"))

        def spans(ends: Column) -> Column:
            return F.transform(found, lambda m, i: let(F.get(ends, i) + F.length(F.get(between, i)), lambda at: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value"), F.get(between, i).alias("left"), F.get(between, i + 1).alias("right"))))

        return F.when(F.size(found) > 0, let(steps, lambda x: let(offsets(x), spans)))

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.coalesce(F.when(text.rlike(hint), let(both, placed)), F.array().cast(SPANS))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _keeps(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start,rank,end>> of the base entities by start, then kind as listed (rank: its place)."""
    def of(r: int, kind: str) -> Column:
        kept = F.filter(matches(text, _PATTERNS[kind], _HINTS[kind]), lambda m: _keeps(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(r).alias("rank"), m["end"].alias("end")))

    kinds = [of(r, kind) for r, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds))


def _bare(x: Column) -> Column:
    """A word in lower case without marks at its ends; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), F.lit(""))


def instances(text: Column, base: Column) -> Column:
    """Identifier-like strings with their patterns; rank is the kind of the base entity that they are part of, or null."""

    def patterns(before: Column, after: Column) -> Column:
        near, far, follows = _bare(F.get(before, F.size(before) - 1)), _bare(F.get(before, F.size(before) - 2)), _bare(F.get(after, F.lit(0)))
        both = F.struct(near.alias("near"), far.alias("far"), follows.alias("follows"))
        said = lambda w: F.array(
            F.when(w["near"] != "", F.concat(F.lit("L "), w["near"])),
            F.when((w["near"] != "") & (w["far"] != ""), F.concat(F.lit("LL "), w["far"], F.lit(" "), w["near"])),
            F.when(w["follows"] != "", F.concat(F.lit("R "), w["follows"])),
            F.when((w["near"] != "") & (w["follows"] != ""), F.concat(F.lit("B "), w["near"], F.lit(" "), w["follows"])),
        )
        return F.array_compact(let(both, said))

    def one(m: Column) -> Column:
        word = F.regexp_replace(m["value"], r"^[^\p{L}\p{N}+@(]+|[^\p{L}\p{N}]+$", "")
        start = m["start"] + F.length(F.regexp_extract(m["value"], r"^([^\p{L}\p{N}+@(]*)", 1))
        end = start + F.length(word)
        over = F.filter(base, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
        words = F.struct(F.split(F.rtrim(m["left"]), r"\s+").alias("before"), F.split(F.ltrim(m["right"]), r"\s+").alias("after"))
        return F.struct(start.alias("start"), end.alias("end"), F.lower(word).alias("value"), let(words, lambda w: patterns(w["before"], w["after"])).alias("patterns"), F.get(over, 0)["rank"].alias("rank"))

    return F.transform(matches(text, _CANDIDATE, "[0-9@]"), one)


def eligible(value: Column) -> Column:
    """What may be added: an address, or five digits at least."""
    return value.rlike("^[^@]+@[^@]+$") | (F.length(_digits(value)) >= 5)


def discover(graph: DataFrame, support: int = 5, threshold: float = 0.8) -> DataFrame:
    """(value, rank) of instances that become known. graph: distinct (pattern, value, rank), rank null where no base entity covers it.

    A pattern's confidence is hits / (instances + 1) for its most frequent kind; it counts from `support` hits on. Every round but the last makes an
    instance known, so rounds end.
    """
    known = graph.where("rank is not null").groupBy("value").agg(F.min("rank").alias("rank"))
    seeds = known = written(known, "seeds")
    links = graph.select("pattern", "value").distinct()
    if links.where(eligible(F.col("value"))).join(known.select("value"), "value", "left_anti").isEmpty():
        return seeds.limit(0)
    while True:
        scored = links.join(known, "value", "left").groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("rank") == r).alias(f"hits{r}") for r in range(len(KINDS))])
        best = F.greatest(*[F.struct(F.col(f"hits{r}").alias("hits"), F.lit(-r).alias("rank")) for r in range(len(KINDS))])
        sure = scored.select("pattern", "n", best.alias("best")).where(F.col("best.hits") >= support).select("pattern", (-F.col("best.rank")).alias("rank"), (F.col("best.hits") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= threshold)
        fresh = links.where(eligible(F.col("value"))).join(sure, "pattern").join(known.select("value"), "value", "left_anti")
        score = 1 - F.exp(F.sum(F.log(1 - F.col("conf"))))
        chosen = fresh.groupBy("value", "rank").agg(score.alias("score")).where(F.col("score") >= threshold)
        chosen = chosen.groupBy("value").agg((-F.max(F.struct("score", (-F.col("rank")).alias("rank")))["rank"]).alias("rank"))
        chosen = written(chosen.select("value", F.col("rank").cast("int").alias("rank")), "chosen")
        if chosen.isEmpty():
            return known.join(seeds.select("value"), "value", "left_anti")
        known = written(known.unionByName(chosen), "known")


def find(docs: DataFrame, text: str = "text", support: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the text, with base and added: arrays of struct<start,rank,end>, by start, then kind as listed."""
    rest = [c for c in docs.columns if c not in (text, "base", "added")]
    names = [f"c{i}" for i in range(len(rest))]
    read = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    both = F.when(F.col("body").rlike("[0-9@]"), let(base_spans(F.col("body")), lambda b: F.struct(b.alias("base"), instances(F.col("body"), b).alias("words"))))
    found = written(read.select(*names, "row", both.alias("x")).select(*names, "row", "x.base", "x.words"), "entities")
    words = found.select("row", F.explode("words").alias("w")).select("row", "w.*").where("value <> ''")
    graph = words.select(F.explode("patterns").alias("pattern"), "value", "rank").distinct()
    new = discover(written(graph, "graph"), support, threshold)
    added = words.where(F.col("rank").isNull() & eligible(F.col("value"))).select("row", "start", "end", "value").join(new, "value").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    out = found.drop("words").join(added, "row", "left")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rest, strict=True)], F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (base and added)."""
    found = find(docs.select("doc_id", "text"))
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return found.select("doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)], F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
