"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A vector's code are the signs of its coordinates after a random rotation; its correction factor f is the inner product of the unit vector
and its code (as a unit vector). The code of one vector and the rotated coordinates of another then give an unbiased estimate of their
cosine, code . y / f, whose error is about sqrt((1 - f^2) / (f^2 (d - 1))). Only pairs whose upper confidence bound reaches the threshold
are recomputed, in double precision; nothing is linked without that.

Pairs to estimate share BITS bits of a code in one of several tables; bits grow with the logarithm of the number of vectors, and tables so
that a pair at the threshold is missed with probability MISS at most. What is dealt out to the tables is only the code of all tables' bits: a pair is
looked at if so few of those differ as the threshold allows (EPSILON standard deviations), and counts in the first table where it meets, so none has to be
remembered. The vectors themselves go only to buckets where they have such a pair. Buckets over BLOCK vectors are dealt out as pairs of blocks.
Equal vectors are one, with a weight and a number of its own, whatever their vec_ids.

Vectors that are null, empty, zero, hold null or non-finite components, or have no vec_id link with nothing. Vectors of other dimensions are not compared.
Rows that share a vec_id but not the vector each have their own vector's links. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, components, scratch, written

THRESHOLD = 0.95
#: Probability of missing a pair that is just at the threshold.
MISS = 1e-3
#: Half-width of the confidence interval, in units of the error.
EPSILON = 5.0
BLOCK = 4096
#: Vectors of a bucket, on average, if all were unrelated.
FILL = 1024


def tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors."""
    bits = max(6, math.ceil(math.log2(max(2, n / FILL))))
    bits = min(bits, 31)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-meet))


def rotations(dim: int, count: int) -> list[np.ndarray]:
    """Random orthogonal matrices, the same everywhere."""
    rng = np.random.default_rng(7)
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Codes of one batch or bucket: packed words, and the key in each table."""

    def __init__(self, packed: list[bytes], bits: int, count: int):
        raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        self.words, self.bits = np.ascontiguousarray(raw).view(np.uint64), bits * count
        x = np.unpackbits(raw, axis=1)[:, : bits * count].reshape(len(raw), count, bits)
        self.keys = x.astype(np.int32) @ (1 << np.arange(bits, dtype=np.int32))

    def pairs(self, table: int, rows: np.ndarray, cols: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of the pairs of rows and cols whose codes allow a link and that no earlier table has. One word is compared first."""
        first, most = _differ(min(64, self.bits), threshold), _differ(self.bits, threshold)
        within = rows is cols
        for low in range(0, len(rows), 256):
            some = rows[low : low + 256]
            i, j = np.nonzero(np.bitwise_count(self.words[some, None, 0] ^ self.words[None, cols, 0]) <= first)
            i, j = some[i], cols[j]
            if within:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65_536):
                p, q = i[at : at + 65_536], j[at : at + 65_536]
                near = np.bitwise_count(self.words[p] ^ self.words[q]).sum(axis=1, dtype=np.int64) <= most
                p, q = p[near], q[near]
                new = ~(self.keys[p, :table] == self.keys[q, :table]).any(axis=1)
                yield p[new], q[new]


def _differ(bits: int, threshold: float) -> float:
    """The most bits of so many that may differ at the threshold."""
    p = math.acos(threshold) / math.pi
    return bits * p + EPSILON * math.sqrt(bits * p * (1 - p)) + 1e-9


def coded(vectors: DataFrame, bits: int, count: int) -> DataFrame:
    """(node, dim, f, code) of vectors (node, embedding); a code is packed into 64-bit words."""
    width = -(-bits * count // 64) * 8

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, x in batch.groupby(batch["embedding"].map(len)):
                if dim not in turn:
                    turn[dim] = rotations(dim, math.ceil(bits * count / dim))
                v = unit(np.stack(x["embedding"].to_list()).astype(np.float64))
                turned = [v @ r.T for r in turn[dim]]
                packed = np.packbits(np.concatenate([t >= 0 for t in turned], axis=1)[:, : bits * count], axis=1)
                packed = np.pad(packed, ((0, 0), (0, width - packed.shape[1])))
                yield pd.DataFrame({"node": x["node"].to_numpy(), "dim": dim, "f": np.abs(turned[0]).sum(axis=1) / math.sqrt(dim), "code": [r.tobytes() for r in packed]})

    return vectors.mapInPandas(code, "node long, dim int, f double, code binary")


_PLACE = ["dim", "t", "key", "lo", "hi"]
_SLIM = "dim int, t int, key int, lo int, hi int, blk int, node long, f double, code binary"


def _sides(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks that are compared; of one block the same array twice."""
    low, high, blk = x["lo"].iloc[0], x["hi"].iloc[0], x["blk"].to_numpy()
    rows = np.flatnonzero(blk == low)
    return (rows, rows) if low == high else (rows, np.flatnonzero(blk == high))


def met(x: pd.DataFrame, bits: int, count: int, threshold: float) -> np.ndarray:
    """Which rows of a bucket have a pair in it whose codes allow a link."""
    codes, out = Codes(list(x["code"]), bits, count), np.zeros(len(x), bool)
    for i, j in codes.pairs(int(x["t"].iloc[0]), *_sides(x), threshold):
        out[i] = out[j] = True
    return out


def bucket_links(x: pd.DataFrame, bits: int, count: int, threshold: float) -> pd.DataFrame | None:
    """node, links, least: for each linked node the weight of its partners, and the smallest node that it is linked with here."""
    dim, n = int(x["dim"].iloc[0]), len(x)
    codes, node, weight, f = Codes(list(x["code"]), bits, count), x["node"].to_numpy(), x["weight"].to_numpy(), x["f"].to_numpy()
    v = unit(np.stack(x["embedding"].to_list()).astype(np.float64))
    turned = v @ rotations(dim, 1)[0].T
    sign = np.where(turned >= 0, 1.0, -1.0)
    error = EPSILON * np.sqrt(np.maximum(0, 1 - f**2) / (f**2 * max(1, dim - 1))) + 1e-9
    total, low = np.zeros(n, np.int64), node.copy()
    found = []
    for i, j in codes.pairs(int(x["t"].iloc[0]), *_sides(x), threshold):
        maybe = np.einsum("ij,ij->i", sign[i], turned[j]) / (math.sqrt(dim) * f[i]) + error[i] >= threshold
        i, j = i[maybe], j[maybe]
        near = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
        i, j = i[near], j[near]
        if len(i):
            np.add.at(total, i, weight[j])
            np.add.at(total, j, weight[i])
            found.append((i.astype(np.int32), j.astype(np.int32)))
    if not found:
        return None
    while True:
        was = low.copy()
        for i, j in found:
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
        if (was == low).all():
            break
    hit = total > 0
    return pd.DataFrame({"node": node[hit], "links": total[hit], "least": low[hit]})


def _by_bucket(look):
    """look, for each bucket of rows that stand in the order of _PLACE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last bucket, which may go on in the next batch
        for x in batches:
            if not len(x):
                continue
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            place = x[_PLACE].to_numpy()
            cuts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, len(x)]
            out = [y for a, b in zip(cuts[:-2], cuts[1:-1], strict=True) if b - a > 1 and (y := look(x.iloc[a:b])) is not None]
            held = x.iloc[cuts[-2] :]
            if out:
                yield pd.concat(out)
        if held is not None and len(held) > 1 and (y := look(held)) is not None:
            yield y

    return run


def links(vectors: DataFrame, n: int, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(node, links, least): one row for a node and bucket in which it has links; least connects all that are linked. vectors: node, weight, embedding."""
    bits, count = tables(n, threshold, miss)
    rows = written(coded(vectors.select("node", "embedding"), bits, count), "codes")
    # bit k of a code is bit 7 - k % 8 of its byte k / 8
    bit = lambda k: F.shiftright(F.conv(F.hex(F.substring("code", k // 8 + 1, 1)), 16, 10).cast("int"), 7 - k % 8).bitwiseAND(1)
    keys = F.array(*[sum((bit(t * bits + b) * (1 << b) for b in range(1, bits)), bit(t * bits)) for t in range(count)])
    placed = rows.select("*", F.posexplode(keys).alias("t", "key"))
    big = placed.groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    placed = placed.join(written(big, "buckets"), ["dim", "t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("dim", "t", "key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "node", "f", "code")

    def meeting(x: pd.DataFrame) -> pd.DataFrame | None:
        there = met(x, bits, count, threshold)
        return x[there] if there.any() else None

    def linked(x: pd.DataFrame) -> pd.DataFrame | None:
        return bucket_links(x, bits, count, threshold)

    in_order = lambda df: df.repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    near = written(in_order(placed).mapInPandas(_by_bucket(meeting), _SLIM), "near")
    return in_order(near.join(vectors.select("node", "weight", "embedding"), "node")).mapInPandas(_by_bucket(linked), "node long, links long, least long")


def groups(table: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept, for every row of table (vec_id, embedding)."""
    bounded_batches(table.sparkSession)
    kind = table.schema["embedding"].dataType
    numbers = F.col("embedding") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(numbers, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(numbers, lambda v: v != 0)
    rows = table.select("vec_id", numbers.alias("embedding"), F.coalesce(fit, F.lit(False)).alias("fit"))
    # equal vectors are put together before anything is compared
    distinct = rows.where("fit").groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    with scratch(table.sparkSession):
        found = written(links(distinct, distinct.count(), threshold, miss), "links", kept=True)
    label = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    # the nodes with links, and what they are called: by the smallest vec_id of a component
    linked = sums.join(label, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))
    linked = linked.join(distinct.select("node", "least_id"), "node")
    names = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(names, "component").select("node", "links", "component_id")
    copies = distinct.join(linked, "node", "left").where("weight > 1 or links is not null").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    good = rows.where("fit").join(copies, "embedding", "left").select("vec_id", "n_links", "component_id")
    out = good.union(rows.where("not fit").select("vec_id", F.lit(None).cast("long"), F.lit(None).cast("long")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def brute_force(vectors: dict[int, list[float] | None], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """vec_id to (n_links, component_id) by all pairs, for tests."""
    good = {k: np.array(v, np.float64) for k, v in vectors.items() if v is not None and len(v) and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(v)}
    ids = sorted(good)
    parent, count = {k: k for k in vectors}, dict.fromkeys(vectors, 0)

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    if ids:
        m = unit(np.stack([good[k] for k in ids]))
        for i, j in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1)), strict=True):
            a, b = ids[i], ids[j]
            count[a] += 1
            count[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (count[k], root(k)) for k in vectors}
