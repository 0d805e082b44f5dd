"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every factor of that text. A whole text (its words in lower case, with one blank
between) is parsed greedily into the longest factors that the automaton knows, across words. A phrase is a reference into the labelled text, so it costs the
logarithm of that text's length: a language with little labelled text has longer references to make up for. The language
with the fewest phrases, normalised so, wins. A letter is a character of Unicode category L; words are letters and marks.

A batch is parsed in lockstep: its texts are cut into segments that are parsed side by side, each as if a phrase began there. Then the phrase that
crosses a cut, and those after it, are followed until one begins where the next segment has a beginning too; from there on both parses are the same.
So the count is exactly that of one pass, and a very long text takes no longer than many short ones.

Labelled text is a bounded sample: SAMPLE_CHARS characters over all languages, an equal share for each and LANGUAGE_CHARS at most, from documents in the
order of a hash of doc_id and text, SAMPLE_DOCS of each language at most. Held-out rows are never learned from. No labelled language is left out.

null text, and text without a letter, is `und` with score 0. Without any labelled text all is `und`. Ties go to the language that is
first in the alphabet. Repeated rows are learned from once, and each have the same result.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, held_out, keep_only

SAMPLE_DOCS, LANGUAGE_CHARS, SAMPLE_CHARS = 200, 60_000, 600_000
UNKNOWN = "und"
#: Characters of a segment, at least and at most, and segments of a batch to aim at.
SEGMENT, SEGMENTS = (256, 8192), 2048
#: Characters that are parsed at once, which bounds what a worker holds.
AT_ONCE = 1 << 20
#: Entries of a table with a place for each state and symbol; larger automata are searched by their edges.
DENSE = 1 << 23

_BLANK, _LETTER, _MARK = 0, 1, 2


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point: blank (whatever stands between words), letter or mark."""
    kinds = {"L": _LETTER, "M": _MARK}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _BLANK) for c in range(0x110000)), np.uint8, 0x110000)


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts' words, each text with a blank on either side and one between words; where each text begins (and the end), and whether it has a letter."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.r_[0, np.cumsum([len(t) for t in low], dtype=np.int64)]
    kind = _classes()[codes]
    letters = np.r_[0, np.cumsum(kind == _LETTER)][starts]
    keep = (kind != _BLANK) | np.r_[True, kind[:-1] != _BLANK] if len(kind) else np.empty(0, bool)
    keep[starts[:-1]] = True
    # the blank before a text's last one may have gone with it: every text ends in exactly one
    places = np.r_[0, np.cumsum(keep)][starts]
    return np.where(kind == _BLANK, np.uint32(32), codes)[keep], places, np.diff(letters) > 0


class SuffixAutomaton:
    """All factors of a text (code points): a walk from state 0 succeeds as long as what was read is one. Kept as edges (state, symbol, to)."""

    def __init__(self, text: np.ndarray):
        self.alphabet, symbols = np.unique(text, return_inverse=True)
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            new = len(length)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(length)
                    moves.append(moves[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.states, self.size = len(moves), len(text)
        out = np.fromiter(map(len, moves), np.int64, len(moves))
        at = np.repeat(np.arange(len(moves)), out) * (len(self.alphabet) + 1)
        key = at + np.fromiter((c for m in moves for c in m), np.int64, out.sum())
        to = np.fromiter((t for m in moves for t in m.values()), np.int32, out.sum())
        order = np.argsort(key)
        self.key, self.to = key[order], to[order]

    # While parsing, a state is the place of its row among the moves; the last row is empty, for where no phrase has begun.

    @functools.cached_property
    def _rows(self) -> tuple[int, int, np.ndarray | None]:
        """Length of a row, the empty one, and all rows in one table if they are few."""
        width = len(self.alphabet) + 1
        nowhere = self.states * width
        if nowhere > DENSE:
            return width, nowhere, None
        table = np.zeros(nowhere + width, np.int32)
        table[self.key] = self.to * width
        return width, nowhere, table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}

    def moves(self, key: np.ndarray) -> np.ndarray:
        """The next states, by state + symbol; 0 where there is none."""
        width, nowhere, table = self._rows
        if table is not None:
            return table.take(key)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[i] == key, self.to[i].astype(np.int32 if nowhere < 1 << 31 else np.int64) * width, 0)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; unknown ones have the last place of a row, where no move is."""
        i = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[i] == codes, i, len(self.alphabet)).astype(np.uint16 if len(self.alphabet) < 1 << 16 else np.int32)

    def phrases(self, codes: np.ndarray, bounds: np.ndarray, distinct: np.ndarray | None = None) -> np.ndarray:
        """Longest-match phrases of each text codes[bounds[k]:bounds[k + 1]]; an unknown character is one. With `distinct`, codes are places in it."""
        total, lengths = len(codes), np.diff(bounds)
        count = np.zeros(len(lengths), np.int64)
        if not total or not len(self.alphabet):
            return count + lengths
        width, nowhere, _ = self._rows
        distinct, codes = np.unique(codes, return_inverse=True) if distinct is None else (distinct, codes)
        own = self.symbols(distinct)
        first = self.moves(np.arange(width))  # from the root
        first = np.where(first == 0, nowhere, first).astype(np.int32 if nowhere < 1 << 31 else np.int64)[own]
        # of each character its symbol, and where a phrase that begins with it is after it
        symbols, first = own.take(codes), first.take(codes)
        size = min(max(total // SEGMENTS, SEGMENT[0]), SEGMENT[1])
        parts = -(-lengths // size)
        offset = np.cumsum(parts) - parts
        text = np.repeat(np.arange(len(lengths)), parts)
        start = bounds[text] + (np.arange(len(text)) - np.repeat(offset, parts)) * size
        stop = np.minimum(start + size, bounds[text + 1])
        order = np.argsort(start - stop, kind="stable")

        # one row for each step, one column for each segment, the longest first
        pos, ending = start[order], (stop - start)[order]
        state = np.full(len(order), nowhere, first.dtype)
        begins = np.zeros(total + 1, bool)
        active = len(order) - np.searchsorted(ending[::-1], np.arange(ending[0]), side="right")
        for low in range(0, len(active), 64):
            some = active[low : low + 64]
            places = np.minimum(pos[: some[0]] + np.arange(low, low + len(some))[:, None], total - 1)
            cs, fs = symbols.take(places), first.take(places)
            missed = np.zeros(places.shape, bool)
            for step, a in enumerate(some.tolist()):
                to = self.moves(state[:a] + cs[step, :a])
                miss = np.equal(to, 0, out=missed[step, :a])
                np.copyto(to, fs[step, :a], where=miss)
                state[:a] = to
            begins[places[missed]] = True
        starts = np.flatnonzero(begins)
        counted = lambda at: np.searchsorted(starts, at)

        # what crosses a cut is followed until it meets the parse beyond it
        meets, more = stop.copy(), np.zeros(len(start), np.int64)
        lane = np.flatnonzero(stop[order] < bounds[text[order] + 1])
        lane, pos, state = order[lane], stop[order][lane], state[lane]
        end = bounds[text[lane] + 1]
        while len(lane):
            to = self.moves(state + symbols[pos])
            new = to == 0
            over = new & begins[pos]
            meets[lane[over]] = pos[over]
            more[lane[new & ~over]] += 1
            state, pos = np.where(new, first[pos], to), pos + 1
            out = ~over & (pos >= end)
            meets[lane[out]] = end[out]
            go = ~over & ~out
            lane, pos, state, end = lane[go], pos[go], state[go], end[go]

        # the one parse of a text goes from segment to segment where they meet
        at = bounds[:-1].copy()
        going = np.flatnonzero(lengths > 0)
        while len(going):
            k = offset[going] + (at[going] - bounds[going]) // size
            count[going] += counted(stop[k]) - counted(at[going]) + more[k]
            at[going] = meets[k]
            going = going[at[going] < bounds[going + 1]]
        return count


class Identifier:
    """Predicts in one process. texts: language to its labelled text."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(plain([texts[x]])[0]) for x in self.languages]
        self.bits = np.array([math.log2(a.size) for a in self.automata])

    def drop(self) -> None:
        """Lets go of what is made for parsing."""
        for a in self.automata:
            a.__dict__.pop("_rows", None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, phrases per character in them. AT_ONCE characters are parsed at once, or one text."""
        sizes = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
        out = [self._predict(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return tuple(sum((list(x[k]) for x in out), []) for k in range(3))

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        codes, bounds, letters = plain([t or "" for t in texts])
        if not self.languages or not len(texts):
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        # few of all code points are there; each automaton has its own symbols for them
        there = np.flatnonzero(np.bincount(codes, minlength=1)).astype(np.uint32)
        number = np.zeros(int(there[-1]) + 1, np.uint16 if len(there) < 1 << 16 else np.uint32)
        number[there] = np.arange(len(there))
        codes = number.take(codes)
        count = np.stack([a.phrases(codes, bounds, there) for a in self.automata], axis=1).astype(np.float64)
        bits = count * self.bits
        best = bits.argmin(axis=1)
        # half of the bits, as the words of a text repeat
        score = 1 / np.exp2((bits.min(axis=1, keepdims=True) - bits) / 2).sum(axis=1)
        rate = count[np.arange(len(texts)), best] / np.maximum(1, np.diff(bounds))
        return [self.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)], np.where(letters, score, 0.0).tolist(), np.where(letters, rate, 1.0).tolist()


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, most: int = LANGUAGE_CHARS, total: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text of each language, within the bounds."""
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**32))
    fit = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select("lang", order.alias("at"), "text")
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    chars = min(most, max(1, total // len(counts)))
    # twice the wanted documents are expected under the limit, repeated rows count once; the first by the hash are taken
    limits = docs.sparkSession.createDataFrame([(x, min(2**32, int(2**32 * 2 * docs_each / n) + 1)) for x, n in counts.items()], "lang string, least long")
    drawn = fit.join(F.broadcast(limits), "lang").where("at < least").groupBy("lang", "at").agg(F.first(F.substring("text", 1, chars)).alias("text"))
    first = drawn.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "text"))), 1, docs_each)["text"].alias("texts"))
    return {r["lang"]: "\n".join(r["texts"])[:chars] for r in first.collect()}


def identify(docs: DataFrame, texts: dict[str, str], text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and phrase_rate of docs[text]; columns of those names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(Identifier(texts))  # a few dozen bytes for each of SAMPLE_CHARS

    def make():
        own = sent.value
        keep_only("langid", own.drop)
        return own.predict

    return appended(docs, text, "lang_pred string, lang_score double, phrase_rate double", make)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    texts = sample(docs.select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), texts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
