"""Near-duplicate groups by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Words are runs of characters other than ASCII white space, after lower-casing A-Z; a document's set are its distinct 5-word shingles (as
64-bit hashes), with fewer words the whole sequence. Documents with equal sets are one node. Every node has TREES
signatures of DEPTH MinHash values; for each tree the nodes stand in the order of their signatures. Of its neighbours there, WIDTH on either side, a node
takes the WIDTH with the longest common prefix as candidates, LEAST values at least. So the depth adapts to the region: where the order is dense the
candidates share long prefixes, where it is sparse short ones do, and no bucket is ever gathered. The orders are range-partitioned by tree, signature and
node, which also splits regions of equal signatures; rows at the ends of partitions are looked at together, so candidates are the same however
the orders are cut.

Candidates whose signatures agree too little for a link (five standard deviations below the threshold) are set aside, the others are confirmed.

Then every larger region (nodes that share LEAST values of a tree, more than WIDTH + 1) that still holds several groups is compared as a whole: its nodes
are dealt out as pairs of blocks, and a task confirms all pairs of its two blocks that are apart, likeliest first, and returns only links that join
groups. So the candidates above decide what is found early, not what is found: every pair that shares LEAST values in some tree and could be a link is
looked at. A pair at the threshold shares none with a probability of 2.4e-7, and is set aside with 3e-7.

null or blank text: an empty set, linked with nothing. Repeated rows are copies of one another. Rows with a null doc_id have
the component's smallest doc_id, which is null if all its rows have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, bounded_batches, components, joined_components, keep_only, scratch, written

TREES, DEPTH, LEAST, WIDTH = 16, 8, 3, 4
#: Nodes of a block.
BLOCK = 512
WORDS = 5
#: Links have 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
REMEMBERED = 200_000

_K = TREES * DEPTH
_ODD = np.random.default_rng(20_240_607).integers(0, 2**63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    span = min(size, n)
    h = w[: n - span + 1] + np.uint64(span)
    for j in range(1, span):
        h = (h ^ (h >> np.uint64(29))) * _P + w[j : n - span + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _Q
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(h: np.ndarray) -> np.ndarray:
    """The K MinHash values, as big-endian 32-bit numbers."""
    low = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):
        np.minimum(low, (h[at : at + 256, None] * _ODD).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def _node(h: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - 2**63


def profiles(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) without the text, with n_shingles, node (of the set; null if empty) and sig."""

    def make():
        keep_only("minhash", _words.clear)

        def said(texts: list[str | None]) -> list[list]:
            sets = [shingles(t) for t in texts]
            return [[len(s) for s in sets], [_node(s) if len(s) else None for s in sets], [signature(s).tobytes() if len(s) else None for s in sets]]

        return said

    return appended(docs, "text", "n_shingles long, node long, sig binary", make, without=True)


def _sketch(sig: bytes) -> bytes:
    """Two bits of each value."""
    low = (np.frombuffer(sig, ">u4") & 3).astype(np.uint8).reshape(-1, 4)
    return (low << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many two-bit values differ, of rows of 64-bit words."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)


def _picks(tree: np.ndarray, sig: np.ndarray, joint: np.ndarray, picking: np.ndarray) -> np.ndarray:
    """Places (i, j) of the neighbours j that each row i in `picking` takes.

    Rows stand in order; joint[i] tells whether row i + 1 is the very next one. Of WIDTH rows on either side a row takes the WIDTH with the longest
    common prefix, of equal ones the nearest, if the prefix has LEAST values or more.
    """
    n = len(tree)
    same = (sig[1:] == sig[:-1]) & (joint & (tree[1:] == tree[:-1]))[:, None]
    prefix = np.r_[np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64), np.zeros(WIDTH, np.int64)][: n + WIDTH - 1]
    low, wide = prefix, np.zeros((2 * WIDTH, n), np.int64)
    for k in range(1, min(WIDTH, n - 1) + 1):
        reach = low[: n - k]  # the common prefix of rows i and i + k
        wide[2 * k - 2, k:], wide[2 * k - 1, : n - k] = reach, reach
        low = np.minimum(low[:-1], prefix[k : k + len(low) - 1])
    wide = wide[:, picking]
    order = np.argsort(-wide, axis=0, kind="stable")[:WIDTH]
    takes = np.take_along_axis(wide, order, axis=0) >= LEAST
    i = np.broadcast_to(picking, takes.shape)[takes]
    step = (order // 2 + 1) * np.where(order % 2, 1, -1)
    return np.stack([i, i + step[takes]], axis=1)


def _arrays(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x["tree"].to_numpy(), np.frombuffer(b"".join(x["sig"]), ">u4").reshape(len(x), DEPTH), x["node"].to_numpy()


def _pairs(x: pd.DataFrame, joint: np.ndarray, picking: np.ndarray) -> pd.DataFrame:
    tree, sig, node = _arrays(x)
    both = node[_picks(tree, sig, joint, picking)]
    return pd.DataFrame({"a": both.min(axis=1), "b": both.max(axis=1)}).drop_duplicates().reindex(columns=_COLUMNS)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of the rows of one partition that have WIDTH rows on either side there, and the rows (2 * WIDTH) at its ends, for the others."""
    part = TaskContext.get().partitionId()
    held, seen, head = None, 0, []  # rows whose place is not past yet
    for x in batches:
        if not len(x):
            continue
        x = x.assign(part=part, at=np.arange(seen, seen + len(x)))
        if seen < 2 * WIDTH:
            head.append(x.head(2 * WIDTH - seen))
        seen += len(x)
        x = x if held is None else pd.concat([held, x], ignore_index=True)
        picking = np.arange(WIDTH, len(x) - WIDTH)
        if len(picking):
            yield _pairs(x, np.ones(len(x) - 1, bool), picking)
        held = x.tail(2 * WIDTH).reset_index(drop=True)
    if seen:
        yield pd.concat([*head, held]).drop_duplicates("at").assign(size=seen).reindex(columns=_COLUMNS)


def _at_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of the rows at the ends of partitions; all of those rows, in order, are one partition here."""
    held = None
    for x, last in _flagged(batches):
        x = x.assign(done=False)
        x = x if held is None else pd.concat([held, x], ignore_index=True)
        if not len(x):
            continue
        part, at, size = (x[c].to_numpy(np.int64) for c in ("part", "at", "size"))
        joint = (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1]) | (part[1:] != part[:-1])
        own = (at < WIDTH) | (at >= size - WIDTH)
        place = np.arange(len(x))
        before = x["done"].to_numpy(bool)
        ready = own & ~before & (last | (place < len(x) - WIDTH))
        if ready.any():
            yield _pairs(x, joint, np.flatnonzero(ready))
        held = x.assign(done=before | ready).tail(2 * WIDTH).reset_index(drop=True)


def _flagged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Each batch with whether it is the last."""
    last = None
    for x in batches:
        if last is not None:
            yield last, False
        last = x
    if last is not None:
        yield last, True


_FOUND = "a long, b long, tree int, sig binary, node long, part int, at long, size long"
_COLUMNS = [c.split()[0] for c in _FOUND.split(", ")]


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of nodes (node, sig) that are neighbours in one of the orders; the same whatever the partitions and batches."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))
    rows = nodes.select("node", F.posexplode(parts).alias("tree", "sig")).select("tree", "sig", "node")
    order = ["tree", "sig", "node"]
    found = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_in_order, _FOUND), "neighbours")
    # a few rows for each partition
    border = found.where("a is null").drop("a", "b").coalesce(1).sortWithinPartitions(*order).mapInPandas(_at_borders, _FOUND)
    return found.where("a is not null").select("a", "b").union(border.select("a", "b")).distinct()


def _bounds(percent: int) -> tuple[float, float]:
    """The least share of equal values, and the most unlike two-bit values, that allow a link: five standard deviations off."""
    t = percent / 100
    p = 0.75 * (1 - t)
    return t - 5 * math.sqrt(t * (1 - t) / _K), _K * p + 5 * math.sqrt(_K * p * (1 - p))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, est) of the pairs whose signatures allow a link; est is the share of equal values."""
    least, _ = _bounds(percent)

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                p, q = (np.frombuffer(b"".join(x[c]), ">u4").reshape(len(x), _K) for c in ("sa", "sb"))
                x = x[["a", "b"]].assign(est=(p == q).mean(axis=1))
                yield x[x["est"] >= least]

    sigs = nodes.select("node", "sig")
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(estimate, "a long, b long, est double")


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sets are a link."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= percent * (len(p) + len(q) - common)


def linked(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of (a, b) whose full sets are alike enough; texts: (node, text)."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets: dict[int, np.ndarray] = {}
            for c in "ab":
                for node, text in zip(x[c], x[f"t{c}"], strict=True):
                    if node not in sets:
                        sets[node] = shingles(text)
            yield x.loc[[_alike(sets[a], sets[b], percent) for a, b in zip(x["a"], x["b"], strict=True)], ["a", "b"]]

    both = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(confirm, "a long, b long")


def apart_in_regions(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(tree, head, node, component, blocks): the nodes of larger regions that hold several components."""
    own = nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "sig")
    heads = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * LEAST)))
    rows = own.select("node", "component", F.posexplode(heads).alias("tree", "head"))
    regions = rows.groupBy("tree", "head").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    regions = regions.where((F.col("n") > WIDTH + 1) & (F.col("low") < F.col("high"))).select("tree", "head", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return rows.join(regions, ["tree", "head"]).select("tree", "head", "node", "component", "blocks")


def _joining(x: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between components of two blocks of a region (or of one), as many as join what they join; a pair counts in the first tree where it meets."""
    least, most = _bounds(percent)
    tree, p, q = (int(x[c].iloc[0]) for c in ("tree", "p", "q"))
    node, component, text = x["node"].to_numpy(), x["component"].to_numpy(), x["text"].to_numpy()
    sig = np.frombuffer(b"".join(x["sig"]), ">u4").reshape(len(x), _K).astype(np.uint32)
    sketch = np.frombuffer(b"".join(map(_sketch, x["sig"])), np.uint64).reshape(len(x), -1)
    heads = sig.reshape(len(x), TREES, DEPTH)[:, :tree, :LEAST]
    left, right = np.flatnonzero(x["block"] == p), np.flatnonzero(x["block"] == q)
    pairs, ests = [], []
    for i in left:
        j = right[right > i] if p == q else right
        j = j[component[j] != component[i]]
        j = j[_unlike(sketch[j], sketch[i]) <= most]
        est = (sig[j] == sig[i]).mean(axis=1)
        new = (est >= least) & ~(heads[j] == heads[i]).all(axis=2).any(axis=1)
        pairs.append(np.stack([np.full(new.sum(), i), j[new]], axis=1))
        ests.append(est[new])
    if not pairs:
        return []
    pairs = np.concatenate(pairs)[np.argsort(-np.concatenate(ests), kind="stable")]
    parent = {c: c for c in component.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    sets: dict[int, np.ndarray] = {}
    found = []
    for i, j in pairs.tolist():
        a, b = root(component[i]), root(component[j])
        if a == b:
            continue
        for k in (i, j):
            if k not in sets:
                sets[k] = shingles(text[k])
        if _alike(sets[i], sets[j], percent):
            parent[max(a, b)] = min(a, b)
            found.append((min(node[i], node[j]), max(node[i], node[j])))
    return found


def joining(apart: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join all components of each region that a link joins; texts: (node, text)."""
    rows = apart.join(nodes.select("node", "sig"), "node").join(texts, "node").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_joining(x, percent), columns=["a", "b"], dtype="int64")

    return rows.select("tree", "head", "p", "q", "block", "node", "component", "sig", "text").groupBy("tree", "head", "p", "q").applyInPandas(compare, "a long, b long").distinct()


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = written(profiles(docs), "profiles")
    # copies are put together before anything is compared; one row's text stands for them
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("text_key", "doc_id")).alias("own"), F.first("sig").alias("sig")), "nodes")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:  # other texts may have the same hash
            yield x[[_node(shingles(t)) == n for t, n in zip(x["text"], x["node"], strict=True)]]

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.join(nodes.select("node", "own.*"), "node").toDF("node", "key", "id")
        found = docs.join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text").mapInPandas(own, "node long, text string")
        return written(found.dropDuplicates(["node"]), "texts")

    with scratch(docs.sparkSession):
        pairs = written(likely(candidates(nodes), nodes, percent), "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        label = components(linked(pairs, texts_of(ends), percent))
        apart = written(apart_in_regions(nodes, label), "apart")
        more = None if apart.isEmpty() else written(joining(apart, nodes, texts_of(apart.select("node").distinct()), percent), "links", kept=True)
    if more is not None and not more.isEmpty():
        label = joined_components(label, more)

    firsts = nodes.select("node", "first_id").join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first_id")
    named = firsts.join(firsts.groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def brute_force(texts: dict[int, str | None], percent: int = PERCENT) -> dict[int, int]:
    """doc_id to component_id by comparing all pairs of exact sets, for tests."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()
    parent = {d: d for d in texts}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}
