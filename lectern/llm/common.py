"""What several operators share: tables in the cluster's shared folder, positions, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    own = "file://" + tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of some MB at most, however long the texts are: what a Python worker holds doesn't grow with them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if now and int(now[1]) > most:  # a size with another unit was set on purpose
        spark.conf.set(name, str(most))


def appended(df: DataFrame, text: str, fields: str, make: Callable[[], Callable[[list[str | None]], list[list]]], without: bool = False) -> DataFrame:
    """df with more columns out of df[text]; columns of their names are replaced, and with `without` the text itself is left out.

    fields are the new columns in DDL; make() is called once in each task and gives a function from the texts of a batch to one list for each new
    column. The other columns pass as Arrow arrays, so that no null makes floating-point numbers of the integers beside it.
    """
    bounded_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    stay = [f for f in df.schema.fields if f.name not in new.names and not (without and f.name == text)]
    kept = [f.name for f in stay]
    columns = list(dict.fromkeys([*kept, text]))
    schema = T.StructType([*stay, *new.fields])
    types = to_arrow_schema(new).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = make()
        for x in batches:
            made = said(x.column(columns.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([x.column(columns.index(c)) for c in kept] + [pa.array(v, t) for v, t in zip(made, types, strict=True)], names=[*kept, *new.names])
            del x, made
            pa.default_memory_pool().release_unused()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


_kept: dict[str, Callable[[], None]] = {}


def keep_only(name: str, drop: Callable[[], None]) -> None:
    """Drops what other operators keep in this Python worker, and gives their memory back; a worker serves one stage after another."""
    first = name not in _kept
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    _kept[name] = drop
    if first:
        give_back()


def give_back() -> None:
    """Returns free memory to the system. Arrow's pool and the C library hold on to it, so that each stage's would stand beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


_scratch: list[list[str]] = []


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation.

    Within `scratch` the table goes when that ends, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not kept:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside and not kept are deleted at the end; what is returned from here must not need them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def crc32_utf8(col):
    """Unsigned CRC-32 of the UTF-8 bytes; null stays null."""
    return F.crc32(F.encode(col, "UTF-8"))


def is_held_out(doc_id: int) -> bool:
    """Rows that no model may learn from: crc32(doc_id as text) mod 4 is 2."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def held_out(col):
    """The same as a column; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of the undirected graph with edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps: each step sends every neighbour of a node to the
    smallest one, so chains shorten geometrically, until all that is left are stars around smallest nodes. One row per edge and step at most:
    neighbourhoods are never gathered in one task, a hub's rows are only joined with its minimum.
    """
    with scratch(edges.sparkSession):
        return written(_stars(edges, rounds), "components", kept=True)


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    raise RuntimeError("components did not converge")


def joined_components(label: DataFrame, more: DataFrame) -> DataFrame:
    """label (node, component) after more edges (a, b); only the components that these join are looked at again."""
    of = lambda df, c: df.join(label.toDF(c, f"c{c}"), c, "left").withColumn(c, F.coalesce(f"c{c}", c)).select("a", "b")
    over = components(of(of(more, "a"), "b"))
    moved = label.join(over.toDF("component", "new"), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    # smallest nodes have no row of their own until they join others
    return moved.union(over)
