"""Secret scans with a trigram inverted index.

Each rule's pattern gives a Boolean trigram query: every way of matching it must spell one of some literals, so a text that
lacks a trigram of each of them can't match. A batch of documents is a segment of the index: its texts are cut into trigrams once, and those that
some query asks for become posting lists (the numbers of the texts that hold them, in order). The lists are intersected and united as the queries
say, and only candidates are verified with the pattern. Rules without mandatory trigrams (runs of a character class) scan every text in full.

A trigram is three bytes of UTF-8, with A-Z as a-z. null text counts as empty: no spans. Spans are code points, end exclusive. Repeated rows each have
their own result, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, keep_only

#: Alternatives of literal text that a part of a pattern may spell, at most; beyond, the part counts as unknown.
SPELLINGS = 64
#: Bytes that are cut into trigrams at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.I, lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: len(m[0]) >= 18),
    # runs shorter than the least length would be dropped; a run is one match either way
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Rules besides, for tokens of fixed public formats.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("bearer", r"\bBearer [A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"\b[a-z][a-z0-9+]{1,12}://[^\s:/@]{1,64}:[^\s:/@]{6,128}@"),
)

# A query: trigram, ("and", ...), ("or", ...), True (no demand).
ALL = True


def _and(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(text: str) -> object:
    b = text.encode().lower()
    return _and([b[i : i + 3] for i in range(len(b) - 2)])


class _Pattern:
    """A pattern as a list of parts: ("set", characters or None if unknown), ("any of", lists of parts), ("repeat", low, high, part).

    What it doesn't read (conditions, references) counts as unknown, which only makes a query weaker.
    """

    def __init__(self, pattern: str, flags: int):
        self.rest, self.flags = pattern, flags

    def take(self, n: int = 1) -> str:
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def known(self, chars: str) -> tuple:
        """A set of characters in lower case; unknown where upper and lower case go beyond ASCII."""
        if self.flags & re.I and not self.flags & re.A and any(not c.isascii() or c.lower() in "iks" for c in chars):
            return "set", None
        return "set", frozenset(c.lower() if c.isascii() else c for c in chars)

    def escaped(self) -> str | None:
        """The character that an escape stands for, or None."""
        c = self.take()
        if c in "xuU":
            return chr(int(self.take({"x": 2, "u": 4, "U": 8}[c]), 16))
        if c.isalnum():
            return {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}.get(c)
        return c

    def bracket(self) -> tuple:
        chars: list[str] | None = []
        if self.rest[0] == "^":
            self.take()
            chars = None
        first = True
        while self.rest[0] != "]" or first:
            first, c = False, self.take()
            c = self.escaped() if c == "\\" else c
            ranged = self.rest[0] == "-" and self.rest[1] != "]"
            if ranged:
                self.take()
                if self.take() == "\\":
                    self.escaped()
            chars = None if chars is None or c is None or ranged or len(chars) > 7 else [*chars, c]
        self.take()
        return ("set", None) if chars is None else self.known("".join(chars))

    def group(self) -> tuple | None:
        if self.rest[0] != "?":
            return "any of", self.ways()
        self.take()
        if self.rest[0] == ":":
            self.take()
        elif self.rest.startswith("P<"):
            self.take(self.rest.index(">") + 1)
        else:  # a condition, reference or flags
            self.ways()
            return "any of", [[("set", None)], []]
        return "any of", self.ways()

    def ways(self) -> list[list]:
        """Alternatives, up to the end of the group, which is taken."""
        out: list[list] = [[]]
        while self.rest and self.rest[0] != ")":
            c = self.take()
            if c == "|":
                out.append([])
                continue
            if c in "^$" or c == "\\" and self.rest[0] in "bBAZz":
                self.take(c == "\\")
                continue
            if c == "\\":
                one = self.escaped()
                part = ("set", None) if one is None else self.known(one)
            else:
                part = self.bracket() if c == "[" else self.group() if c == "(" else ("set", None) if c == "." else self.known(c)
            times = re.match(r"\{(\d+)(,?)(\d*)\}|[*+?]", self.rest)
            if times:
                self.take(times.end())
                mark = times[0]
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(mark) or (int(times[1]), int(times[1]) if not times[2] else int(times[3]) if times[3] else None)
                part = ("repeat", low, high, part)
                self.take(self.rest[:1] in ("?", "+"))
            out[-1].append(part)
        self.take()
        return out


def _spelled(parts: list) -> tuple[list[set[str] | None], list]:
    """The spellings of each part in turn (None: unknown), and demands of parts that are no plain spelling."""
    out: list[set[str] | None] = []
    demands: list = []
    for kind, *arg in parts:
        if kind == "set":
            out.append(None if arg[0] is None else set(arg[0]))
        elif kind == "any of":
            ways = [_spelled(x) for x in arg[0]]
            if len(ways) == 1:
                out += ways[0][0]
                demands += ways[0][1]
                continue
            texts = [_texts(w) for w, _ in ways]
            if all(t is not None for t in texts) and len(set().union(*texts)) <= SPELLINGS:
                out.append(set().union(*texts))
            else:
                demands.append(_or([_and([_query_of(w), *d]) for w, d in ways]))
                out.append(None)
        else:
            low, high, inner = arg
            once, more = _spelled([inner])
            texts = _texts(once)
            if texts is not None and high == 1 and low == 0:
                out.append({"", *texts})
            elif texts is not None and low == high and len(texts) ** low <= SPELLINGS:
                out += [texts] * low
            else:
                if low:
                    demands += [_query_of(once), *more]
                out.append(None)
    return out, demands


def _texts(parts: list[set[str] | None]) -> set[str] | None:
    """All texts that the parts spell together, if they are known and few."""
    out = {""}
    for p in parts:
        if p is None or len(out) * len(p) > SPELLINGS:
            return None
        out = {a + b for a in out for b in p}
    return out


def _query_of(parts: list[set[str] | None]) -> object:
    demands, run = [], {""}
    for p in [*parts, None]:
        if p is None or len(run) * len(p) > SPELLINGS:
            demands.append(_or([_grams(t) for t in run]))
            run = {""} if p is None else p
        else:
            run = {a + b for a in run for b in p}
    return _and(demands)


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean trigram query that every text with a match of the pattern meets."""
    parts, demands = _spelled([("any of", _Pattern(pattern, flags).ways())])
    return _and([_query_of(parts), *demands])


def trigrams(query: object) -> set[bytes]:
    return set() if query is ALL else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1:]))


class Index:
    """Which trigrams the posting lists are kept for: a table from each three bytes to its number, 0 for none."""

    def __init__(self, grams: list[bytes]):
        self.grams = grams
        self.numbers = np.zeros(1 << 24, np.uint8 if len(grams) < 256 else np.uint16)
        for k, g in enumerate(grams):
            self.numbers[int.from_bytes(g)] = k + 1


class Segment:
    """The inverted index of one batch of texts."""

    def __init__(self, texts: list[str], index: Index):
        self.n = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        b = np.frombuffer(b"\xff".join(raw).lower(), np.uint8)  # no text holds that byte
        found = []
        for low in range(0, max(0, len(b) - 2), CHUNK):  # what is held besides the texts doesn't grow with them
            part = b[low : low + CHUNK + 2].astype(np.int32)
            number = index.numbers.take(part[:-2] << 16 | part[1:-1] << 8 | part[2:])
            at = np.flatnonzero(number)
            found.append(np.unique(number[at].astype(np.int64) * self.n + np.searchsorted(ends, at + low, side="right")))
        posts = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        cuts = np.searchsorted(posts, np.arange(1, len(index.grams) + 2) * self.n)
        self.postings = {g: posts[cuts[k] : cuts[k + 1]] - (k + 1) * self.n for k, g in enumerate(index.grams)}

    def candidates(self, query: object) -> np.ndarray:
        """Numbers of the texts that meet a query, in order."""
        if query is ALL:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        kind, *parts = query
        lists = sorted((self.candidates(q) for q in parts), key=len)
        out = lists[0]
        for x in lists[1:]:
            if kind == "and" and not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True) if kind == "and" else np.union1d(out, x)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.index = Index(sorted(set().union(*(trigrams(q) for _, _, q in self.rules))))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rank of the kind, end), in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment(texts, self.index)
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in segment.candidates(query).tolist():
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if rule.keep(m)]
        for x in found:
            x.sort()
        return found


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with the spans of every rule in `out` (a column of that name is replaced), by start, then in the order of the rules."""
    kinds = [r.kind for r in rules]

    def make():
        keep_only("secrets", lambda: None)
        scanner = Scanner(rules)
        return lambda texts: [[[{"kind": kinds[k], "start": s, "end": e} for s, k, e in y] for y in scanner.spans([t or "" for t in texts])]]

    return appended(df, text, f"`{out}` {SPANS}", make)


def redact(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every secret in df[text] replaced; overlapping spans are replaced as one. null stays null."""

    def make():
        keep_only("secrets", lambda: None)
        scanner = Scanner(rules)
        return lambda texts: [[_without(t, spans, mark) for t, spans in zip(texts, scanner.spans([t or "" for t in texts]), strict=True)]]

    return appended(df, text, f"`{text}` string", make).select(*[F.col(f"`{c}`") for c in df.columns])


def _without(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans (all kinds)."""
    found = find(docs.select("doc_id", "text")).drop("text")
    base = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, base), F.sha2(said(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"), F.size("secrets").cast("long").alias("n_spans"))


def brute_force(text: str) -> list[tuple[str, int, int]]:
    """The base spans by plain patterns, for tests."""
    out = []
    for k, r in enumerate(BASE):
        pattern = r"[0-9a-f]+" if r.kind == "hex" else r.pattern
        out += [(m.start(), k, m.end(), r.kind) for m in re.finditer(pattern, text, r.flags) if (len(m[0]) >= 16 if r.kind == "hex" else r.keep(m))]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
