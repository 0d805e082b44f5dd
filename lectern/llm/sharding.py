"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard has `vnodes` virtual nodes on a ring of POINTS points; a key belongs to the next virtual node clockwise. A shard
takes no more than its capacity: keys beyond it continue clockwise to the next shard with room. Without slack the
capacities add up to the number of rows, so counts are at most one apart (the law is `rows`); with slack fewer keys move.

How many keys an arc of the ring has decides which ranks of them overflow, and to where. So the driver only sees one
count for each virtual node, and a hot key, whose rows share an arc, is placed by ranks that each part counts for itself.

null keys are hashed like any other value. Repeated rows are all placed. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_utf8, written

POINTS = 1 << 14
VNODES = 64


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise. A taken point is passed to the next free one; more shards never move these."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = zlib.crc32(f"{shard}/{v}".encode()) * 2654435761 % 2**32 * POINTS >> 32
            while at in taken:
                at = (at + 1) % POINTS
            taken[at] = shard
    return sorted(taken.items())


def arcs(nodes: list[tuple[int, int]]) -> list[int]:
    """For each point of the ring, the place in `nodes` of the next virtual node clockwise, itself included."""
    out, k = [], 0
    for point in range(POINTS):
        while k < len(nodes) and nodes[k][0] < point:
            k += 1
        out.append(k % len(nodes))
    return out


def clockwise(nodes: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards in the order in which a key of that arc meets them."""
    return list(dict.fromkeys(nodes[(arc + i) % len(nodes)][1] for i in range(len(nodes))))


def capacities(total: int, shards: int, slack: float, wanted: list[int]) -> list[int]:
    """Rows that each shard may take. Without slack: the mean, and one more for those that want most."""
    if slack > 0:
        return [-(-int(total * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards
    low, more = divmod(total, shards)
    first = sorted(range(shards), key=lambda s: (-wanted[s], s))[:more]
    return [low + (s in first) for s in range(shards)]


def flow(counts: dict[int, int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[dict]:
    """Runs of ranks within an arc and where they go: arc, from_rank, to_rank, shard, slot (of the first)."""
    nodes = ring(shards, vnodes)
    order = {a: clockwise(nodes, a) for a in counts}
    wanted = [sum(n for a, n in counts.items() if order[a][0] == s) for s in range(shards)]
    room = capacities(sum(counts.values()), shards, slack, wanted)
    load, done, runs = [0] * shards, dict.fromkeys(counts, 0), []
    for step in range(shards):
        for a in sorted(counts):
            s = order[a][step]
            n = min(counts[a] - done[a], room[s] - load[s])
            if n > 0:
                runs.append({"arc": a, "from_rank": done[a], "to_rank": done[a] + n, "shard": s, "slot": load[s]})
                done[a], load[s] = done[a] + n, load[s] + n
    return runs


def assign(df: DataFrame, key: str, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within the shard); columns of those names are replaced.

    df is evaluated once, into a table; it should hold slim columns only.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in ("shard", "slot")]
    names = [f"c{i}" for i in range(len(rest))]
    points = F.split(F.lit(",".join(map(str, arcs(ring(shards, vnodes))))), ",")
    point = F.pmod(F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), F.lit(POINTS)).cast("int")
    keyed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names, strict=True)], F.element_at(points.cast("array<int>"), point + 1).alias("arc"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    keyed = written(keyed, "keys")
    counted = keyed.groupBy("part", "arc").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("part", "arc", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # one count for each virtual node
    total = {r["arc"]: r["n"] for r in counted.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    runs = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(flow(total, shards, vnodes, slack))), "array<struct<arc:int,from_rank:long,to_rank:long,shard:int,slot:long>>"))).withColumnRenamed("slot", "first")
    rank = F.row_number().over(Window.partitionBy("part", "arc").orderBy("row")) - 1
    ranked = keyed.withColumn("rank", rank).join(base, ["part", "arc"]).withColumn("rank", F.col("rank") + F.col("base"))
    # at most shards runs for each virtual node
    out = ranked.join(F.broadcast(runs), (ranked["arc"] == runs["arc"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return out.select(*[F.col(n).alias(c) for c, n in zip(rest, names, strict=True)], "shard", (F.col("first") + F.col("rank") - F.col("from_rank")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. null text: size 1, the CRC of no bytes. Rows are keyed by doc_id."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc32_utf8(text).alias("text_crc32"))
    out = assign(slim, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
