"""Shared helpers: the shared scratch folder, cut lineage, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder, ship


def release() -> None:
    """Give freed memory back to the system.  A worker lives on after its task, and what Arrow and the C library keep of
    freed blocks would count beside all that the executor runs next."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def on_group(fn: Callable, **fixed) -> Callable:
    """``fn`` with some arguments fixed, as applyInArrow takes it (it reads type hints); memory is given back after large groups."""

    def call(group: pa.Table) -> pa.Table:
        large = group.nbytes > 1_000_000
        out = fn(group, **fixed)
        del group
        if large:
            release()
        return out

    return call


def on_batches(fn: Callable, **fixed) -> Callable:
    """``fn`` with some arguments fixed, as mapInArrow takes it; memory is given back after each batch and at the end."""

    def call(batches):
        def each():
            for batch in batches:
                yield batch
                del batch
                release()

        yield from fn(each(), **fixed)
        release()

    return call


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch paths made in the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = folder(spark, name)
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the scratch tables made inside; those still in the list at the end are deleted."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        remove(spark, *made)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends there,
    so a lost executor costs a reread, never the steps before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Bytes of a side (keys and values, as counted from the written table) up to which it may be broadcast.
BROADCAST_BYTES = 64_000_000


def small_or_shuffled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, with a broadcast hint if its strings, binaries, lists and
    numbers come to ``BROADCAST_BYTES`` at most; a larger one is joined by shuffle."""
    kept, _ = saved(df, name)
    wide = [F.sum(F.octet_length(F.coalesce(F.col(c), F.lit(b"" if t == "binary" else "")))) for c, t in kept.dtypes if t in ("string", "binary")]
    wide += [F.sum(F.greatest(F.size(c), F.lit(0)).cast("long") * 8) for c, t in kept.dtypes if t == "array<bigint>"]
    rows, *sizes = kept.agg(F.count("*"), *wide).first()
    return F.broadcast(kept) if rows * 32 + sum(x or 0 for x in sizes) <= BROADCAST_BYTES else kept


#: Edges of a graph up to which a row for each of its nodes (16 bytes; two nodes an edge at most) is broadcast: 16 MB.
NODES = 500_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(u, v)`` as ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternating large-star and
    small-star steps; each is a minimum per node and a join.  The minima, a row
    a node, are broadcast up to ``NODES`` edges, so a hub's edges stay where they
    are; beyond that they are written first, so both sides of the join are
    shuffles and adaptive execution splits a hub.  Null ends and self loops are
    ignored; no edges, no rows.
    """
    now, path = saved(edges.where("u <> v").select("u", "v").distinct(), "edges")
    if now.isEmpty():
        remove(now.sparkSession, path)
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    state, number = None, now.count()
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        scratch: list[str] = []

        def minima(df: DataFrame, number: int = number, scratch: list[str] = scratch) -> DataFrame:
            if number <= NODES:
                return F.broadcast(df)
            kept, path = saved(df, "minima")
            scratch.append(path)
            return kept

        least = minima(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: large leaves every edge pointing from the larger end to the smaller.
        low = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        nxt, nxt_path = saved(small, "edges")
        remove(now.sparkSession, path, *scratch)
        now, path = nxt, nxt_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        number = seen[0]
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
