"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Learning (never from held-out rows) takes a bounded sample of labelled rows, SAMPLE of each class at most, in the order of a hash.
Words, and stems that begin many words, that mark toxic texts far more often than clean ones are the lexicon. It is a
trie; Levenshtein automata of its terms run over that trie together, as one automaton whose states are made when a word
first needs them, so misspelled terms (an insertion, deletion, substitution or swap; two from TWO_FROM letters on) cost no more than exact ones.
Terms stand beside the stems they begin with, and a term, exact or misspelled, goes before a stem. Words that clean samples use are not misspellings. Each hit is weighed by its context window: within quotation marks, or beside words
that report speech, it is a quotation and counts in another feature than abuse does. A logistic regression over the features gives the score.

null text counts as empty. A text without hits has the score of the intercept. Without labelled rows of both classes all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, held_out, keep_only, scratch, written

SAMPLE = 6000
#: Terms and stems, at most, and what makes one: toxic documents, and how much more often than in clean ones.
TERMS, STEMS, SUPPORT, LIFT, STEM_LIFT = 1000, 300, 4, 12.0, 6.0
#: Evidence (natural logarithm of the odds against chance) that is asked for: beyond that of the number of words with SUPPORT documents, so that it follows
#: the sample; and as larger samples hold more copies, whose words occur together, half as much again there. 7.6 for 700 words, 14.9 for 100,000.
CHANCE, COPIES = 1.0, (1.5, 2.4)
STEM_LENGTHS, STEM_WORDS = (4, 5, 6), 4
ONE_FROM, TWO_FROM = 5, 10
WINDOW = 8
STEM = 9
THRESHOLD = 0.3
REMEMBERED = 250_000
STATES = 200_000

# Words that report speech, and words that address somebody, in the languages of the corpus.
REPORTING = frozenset("said says say saying wrote writes written called calls quote quoted quotes quoting cited word words term terms phrase reported reports dit disait écrit mot mots citation selon sagte sagt schrieb wort wörter zitat laut dijo dice escribió palabra palabras cita según".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu toi te vous du dich dir sie eres usted tú".split())
OPEN, CLOSE, BOTH = "“„«‹‘", "”»›’", '"'

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LOOKS = str.maketrans("013457@$!|", "oieastasil")


class Lexicon:
    """Trie of terms (whole words) and stems (beginnings of words), and the automaton over it."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # edits that the term which ends here allows
        self.stem: list[bool] = [False]
        self.most: list[int] = [0]  # edits that some term below allows
        for word, stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            edits = 0 if stem else (len(word) >= ONE_FROM) + (len(word) >= TWO_FROM)
            at = 0
            self.most[0] = max(self.most[0], edits)
            for c in word:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(-1)
                    self.stem.append(False)
                    self.most.append(0)
                at = self.child[at][c]
                self.most[at] = max(self.most[at], edits)
            if stem:
                self.stem[at] = True
            else:
                self.term[at] = edits
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int] = []  # 0 no term, else 1 + edits
        self.begins: list[bool] = []
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With letters of terms left out; dominated items are dropped."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, wait = todo.pop()
            if e > self.most[node] or best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(x, e + 1, "") for x in self.child[node].values()]
        return frozenset((n, e, w) for (n, w), e in best.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.moves.append({})
            ends = [e for n, e, w in items if not w and e <= self.term[n]]
            self.ends.append(1 + min(ends) if ends else 0)
            self.begins.append(any(self.stem[n] and not e and not w for n, e, w in items))
        return self.ids[items]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:  # the second of two swapped letters
                if c == wait:
                    out.add((node, e, ""))
                continue
            if c in self.child[node]:
                out.add((self.child[node][c], e, ""))
            if e < self.most[node]:
                out.add((node, e + 1, ""))
                for d, x in self.child[node].items():
                    out.add((x, e + 1, ""))
                    if c in self.child[x] and d != c:
                        out.add((self.child[x][c], e + 1, d))
        items = self._closed(out)
        to = self._state(items) if items else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int:
        """0: no term; 1: a term; 1 + edits: a misspelled term; STEM: another word that begins with a stem."""
        if len(self.sets) > STATES:
            self._reset()
        at, stem = self.start, False
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at < 0:
                return STEM if stem else 0
            stem = stem or self.begins[at]
        return self.ends[at] or (STEM if stem else 0)

    def stemmed(self, word: str) -> int:
        """STEM if the word begins with a stem, else 0."""
        at = 0
        for c in word:
            if c not in self.child[at]:
                break
            at = self.child[at][c]
            if self.stem[at]:
                return STEM
        return 0


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    usual: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=list)  # intercept first; none: nothing was learned


#: strength of hits, words with a stem, quotations, address beside hits, hits in a hundred words, length of a text with hits
FEATURES = 6


class Scorer:
    """Scores texts in one process."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.terms, model.stems)
        self.known: dict[str, int] = {}

    def strength(self, chunk: str) -> int:
        """Of a run without white space: 0 no hit, 1 + edits of a hit; STEM: only a stem."""
        found = self.known.get(chunk)
        if found is None:
            word = _EDGE.sub("", chunk)
            found = self.lexicon.match(word)
            if found in (0, STEM) and (plain := word.translate(_LOOKS)) != word:
                looks = self.lexicon.match(plain)
                found = max(looks, 2) if 0 < looks < STEM else found or looks
            if 1 < found < STEM and word in self.model.usual:
                found = self.lexicon.stemmed(word) or self.lexicon.stemmed(word.translate(_LOOKS))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if len(chunk) <= 64:
                self.known[chunk] = found
        return found

    def hits(self, text: str) -> list[tuple[int, int, bool, bool]]:
        """(place among the words, edits, quoted, addressed) of each hit."""
        words = text.lower().split()
        known, strength = self.known, self.strength
        codes = [known[w] if w in known else strength(w) for w in words]
        if not any(codes):
            return []
        return [(i, c - 1, quoted(words, i), addressed(words, i)) for i, c in enumerate(codes) if c]

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        found = self.hits(text)
        if not found:
            return [0.0] * FEATURES
        abuse = sum(0.85**e for _, e, q, _ in found if not q and e < STEM - 1)
        stems = sum(not q and e == STEM - 1 for _, e, q, _ in found)
        said = sum(q for *_, q, _ in found)
        near = sum(a for *_, q, a in found if not q)
        words = len(text.split())
        return [math.log1p(abuse) + (abuse > 0), math.log1p(stems) + (stems > 0), math.log1p(said), math.log1p(near), min(3.0, 100 * (abuse + stems) / words), math.log1p(words / 100) * (abuse + stems > 0)]

    def score(self, text: str | None) -> float:
        w = self.model.weights
        if not w:
            return 0.0
        z = w[0] + sum(a * b for a, b in zip(w[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def quoted(words: list[str], i: int) -> bool:
    """Within quotation marks that open before the word and close after it, or with a word that reports speech beside quotation marks."""
    before, after = " ".join(words[max(0, i - 4 * WINDOW) : i]), " ".join(words[i + 1 : i + 1 + 4 * WINDOW])
    own = words[i]
    lead = own[: len(own) - len(own.lstrip(OPEN + BOTH + "'(["))]
    trail = own[len(own.rstrip(CLOSE + BOTH + "'.,;:!?)]")) :]
    left, right = before + lead, trail + after
    straight = left.count('"') % 2 == 1 and '"' in right
    curly = sum(map(left.count, OPEN)) > sum(left.count(c) for c in "”»›") and any(c in right for c in CLOSE)
    reported = any(_EDGE.sub("", w) in REPORTING for w in words[max(0, i - WINDOW) : i])
    single = reported and lead.endswith("'") and "'" in trail + after
    return straight or curly or single


def addressed(words: list[str], i: int) -> bool:
    return any(_EDGE.sub("", w) in ADDRESS for w in words[max(0, i - WINDOW) : i + WINDOW + 1])


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(toxic, text) of the rows to learn from: SAMPLE of each class at most, by a hash of doc_id."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.crc32(F.encode(F.concat(F.lit("toxic "), F.col("doc_id").cast("string")), "UTF-8"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("order", order)
    chosen = there.where("toxic = 1").orderBy("order", "doc_id").limit(most).union(there.where("toxic = 0").orderBy("order", "doc_id").limit(most)).select("doc_id", "toxic")
    # at most 2 * SAMPLE rows
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))


def _words(col):
    """Distinct lower-case words without marks at their ends."""
    trimmed = F.transform(F.array_distinct(F.split(F.lower(col), r"\s+")), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$")))


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The lexicon and the weights, from a sample whose size is bounded, whatever the size of docs."""
    with scratch(docs.sparkSession):
        return _learned(docs, labels, most)


def _learned(docs: DataFrame, labels: DataFrame, most: int) -> Model:
    spark = docs.sparkSession
    rows = written(sample(docs, labels, most), "labelled")
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return Model()
    words = rows.withColumn("row", F.monotonically_increasing_id()).select("toxic", "row", F.explode(_words(F.col("text"))).alias("word"))
    words = written(words, "words")
    lift = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    seen = [F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")]
    base, share = bad / (bad + good), F.col("bad") / (F.col("bad") + F.col("good"))
    odds = F.col("bad") * F.log(share / base) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - base))).otherwise(0.0)

    counts = written(words.groupBy("word").agg(*seen), "counts")
    tried = math.log(max(1, counts.where(F.col("bad") + F.col("good") >= SUPPORT).count()))
    evidence = max(tried + CHANCE, COPIES[0] * tried - COPIES[1])
    marked = lambda df, least: df.withColumn("lift", lift).withColumn("odds", odds).where((F.col("bad") >= SUPPORT) & (F.col("lift") >= least) & (F.col("odds") >= evidence))
    terms = [r["word"] for r in marked(counts, LIFT).orderBy(F.desc("odds"), "word").limit(TERMS).collect()]
    beginnings = words.select("toxic", "row", "word", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS])).alias("stem")).where("stem is not null")
    stems = beginnings.groupBy("stem", "row", "toxic").agg(F.min("word").alias("least"), F.max("word").alias("most")).groupBy("stem")
    stems = stems.agg(*seen, F.size(F.array_distinct(F.flatten(F.collect_set(F.array("least", "most"))))).alias("words"))
    chosen: list[str] = []
    for r in marked(stems.where(F.col("words") >= STEM_WORDS), STEM_LIFT).orderBy(F.desc("odds"), F.desc(F.length("stem")), "stem").limit(STEMS).collect():
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in chosen):
            chosen.append(r["stem"])
    found = words.where("toxic = 0").select("word").distinct()
    model = Model(terms, chosen)
    model.usual = frozenset(r["word"] for r in _fuzzy(found, model).collect())
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("toxicity", lambda: None)
        scorer = Scorer(sent.value)
        for x in batches:
            yield pd.DataFrame({"toxic": x["toxic"], "x": [scorer.features(t) for t in x["text"]]})

    data = rows.select("toxic", "text").mapInPandas(measure, "toxic int, x array<double>").collect()  # FEATURES numbers for each row of the sample
    model.weights = fit(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float))
    return model


def _fuzzy(words: DataFrame, model: Model) -> DataFrame:
    """Words of clean samples that a misspelled term would match: they are words of their own."""
    sent = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only("toxicity", lambda: None)
        lexicon = Lexicon(sent.value.terms, sent.value.stems)
        for x in batches:
            yield x[[1 < lexicon.match(w) < STEM or 1 < lexicon.match(w.translate(_LOOKS)) < STEM for w in x["word"]]]

    return words.mapInPandas(run, "word string")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> list[float]:
    """Logistic regression by Newton steps; the features are no less toxic the more there is of them, but for quotations."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1) of docs[text]; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by TERMS, STEMS and the sample

    def make():
        keep_only("toxicity", lambda: None)
        scorer = Scorer(sent.value)
        return lambda said: [list(map(scorer.score, said))]

    return appended(docs, text, "toxicity double", make)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, for tests."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def lexicon_words(texts: list[str]) -> Counter:
    """Words of some texts, as the lexicon sees them."""
    return Counter(_EDGE.sub("", w) for t in texts for w in t.lower().split())
