"""Best-fit decreasing packing of token documents into windows of a fixed length.

Overlong documents are first cut into full windows; what remains of each is placed longest first into the tightest open window
that takes it. How many pieces there are of each length decides everything, so the plan is made from that histogram
(at most `window` counts, however many rows): a segment tree indexed by remaining capacity finds the tightest open windows,
and all pieces of a length are placed in runs. Ranks of pieces within their length then say where each one goes.

null text is empty. An empty document holds the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Codec, encode_with
from .common import bounded_batches, written

WINDOW, END_ID = 2048, 1


class Capacities:
    """A segment tree over remaining capacities 0..size: which of them have open windows."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.tree = [False] * (2 * self.width)

    def put(self, r: int, there: bool) -> None:
        i = r + self.width
        self.tree[i] = there
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that has a window."""
        i = least + self.width
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i + (not self.tree[2 * i])
                return i - self.width
            i //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs (first rank, first window, pieces a window, offset) of best-fit decreasing.

    The rank r of a run goes to window `first + (r - first rank) // pieces`, at `offset + (r - first rank) % pieces * length`.
    Windows with equal capacity are alike, so whole runs of them are filled at once, with the result of one by one.
    """
    tree, open_, runs, windows = Capacities(window), {}, {}, 0
    for length in sorted((n for n, k in counts.items() if k), reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} ids doesn't fit")
        left, at, out = counts[length], 0, []

        def put(first: int, n: int, r: int) -> None:
            if n and r:
                open_.setdefault(r, []).append((first, n))
                tree.put(r, True)

        while left:
            r = tree.tightest(length)
            if r is None:
                first, n, r = windows, -(-left // (window // length)), window
                windows += n
            else:
                first, n = open_[r].pop()
                if not open_[r]:
                    tree.put(r, False)
            each = r // length
            full = min(n, left // each)
            if full:
                out.append((at, first, each, window - r))
                at, left = at + full * each, left - full * each
                put(first, full, r - full_length(each, length))
            if full < n:
                if left and left < each:  # the last one is filled in part
                    out.append((at, first + full, each, window - r))
                    put(first + full, 1, r - left * length)
                    at, left, full = at + left, 0, full + 1
                put(first + full, n - full, r)
        runs[length] = out
    return runs


def full_length(pieces: int, length: int) -> int:
    return pieces * length


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and end id, cut into full windows and a rest.

    doc_id, start, length, ids (little-endian, binary), doc_tokens, and part and pos: the place among the pieces of that
    length that one task made.
    """
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("start long, length int, ids binary, doc_tokens long, part int, pos long").fields])
    end = array("I", [end_id]).tobytes()
    seen: dict[tuple, Counter] = {}

    def make(_: Codec, rows: pa.Table, ids: list[bytes]) -> pa.Table:
        task = TaskContext.get()
        key = (task.stageId(), task.partitionId(), task.taskAttemptId())
        if key not in seen:
            seen.clear()
        count, out = seen.setdefault(key, Counter()), []
        for row, i in enumerate(ids):
            whole = i + end
            n = len(whole) // 4
            for start in range(0, n, window):
                cut = whole[4 * start : 4 * (start + window)]
                length = len(cut) // 4
                out.append((row, start, length, cut, n, task.partitionId(), count[length]))
                count[length] += 1
        row, *made = zip(*out, strict=True) if out else [()] * 7
        made = [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
        return pa.Table.from_arrays([rows.column("doc_id").take(pa.array(row, pa.int64())), *made], names=schema.names)

    return encode_with(docs, path, make, schema)


def place(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id and offset for rows with length, part and pos (as `pieces` makes them).

    Only counts by (part, length) are shuffled together; a length that a third of all rows share is no hot key.
    """
    spark = lengths.sparkSession
    bounded_batches(spark)
    counted = lengths.groupBy("part", "length").agg((F.max("pos") + 1).alias("n"))
    # running sums over the parts, of one row for each part and length
    base = counted.select("part", "length", (F.sum("n").over(_before()) - F.col("n")).alias("base"))
    total = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    runs = plan(total, window)
    sent = spark.sparkContext.broadcast({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()})
    ranked = lengths.join(base, ["part", "length"])
    schema = T.StructType([*lengths.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = lengths.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            number = lambda name, x=x: x.column(name).to_numpy(zero_copy_only=False)
            rank, length = number("base") + number("pos"), number("length")
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, window_, each, offset = sent.value[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                over = rank[at] - first[k]
                seq[at], off[at] = window_[k] + over // each[k], offset[k] + over % each[k] * n
            yield pa.RecordBatch.from_arrays([*(x.column(n) for n in names), pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(placed, schema)


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def where(runs: list[tuple[int, int, int, int]], length: int, rank: int) -> tuple[int, int]:
    """(window, offset) of one piece, by the plan."""
    first, window, each, offset = runs[bisect_right(runs, (rank, float("inf"))) - 1]
    return window + (rank - first) // each, offset + (rank - first) % each * length


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces in sequences: doc_id, start, length, ids (array<int>), doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, path, window, end_id), "pieces")
    out = place(cut, window).drop("part", "pos")

    @F.pandas_udf("array<int>")
    def listed(x: pd.Series) -> pd.Series:
        return pd.Series([array("i", b).tolist() for b in x])

    return out.withColumn("ids", listed("ids"))


def digests(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """As pack, with ids_crc32 instead of the ids; only the digests are stored between encoding and placing."""
    cut = pieces(docs, path, window, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    out = place(written(cut, "pieces"), window)
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_one_by_one(lengths: list[int], window: int = WINDOW) -> list[int]:
    """Best-fit decreasing of single pieces; the loads of the windows. The brute-force version for tests."""
    loads: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(window - x, k) for k, x in enumerate(loads) if window - x >= n]
        if fits:
            loads[min(fits)[1]] += n
        else:
            loads.append(n)
    return loads


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(array("I", ids).tobytes())
