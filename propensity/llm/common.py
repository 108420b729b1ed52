"""Helpers shared by the operators: scans, materialised tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.session import checkpoint, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, read back: lineage ends
    there, and a lost executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name like ``stem`` that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in have:
        name += "_"
    return name


def content_key(*cols: Column) -> Column:
    """128 bits that stand for the values of ``cols``: two seeded 64-bit hashes."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("second"), *cols).alias("b"))


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str,
              prepare: Callable[[], None] | None = None) -> DataFrame:
    """``fn`` on all rows of each group of the integer columns ``keys``.

    Rows are dealt by the keys and sorted, and the groups cut from the stream of Arrow
    batches, so thousands of small groups cost no more than their rows.  A group has to
    fit in a task's memory: callers split large ones by the keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            cols = [part[k].to_numpy() for k in keys]
            new = np.zeros(len(part), dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            if held:
                new[0] = any(held[-1][k][-1].as_py() != c[0] for k, c in zip(keys, cols))
            cuts = np.flatnonzero(new)
            if not len(cuts):
                held.append(part)
                continue
            first = pa.concat_tables([*held, part.slice(0, cuts[0])])
            if len(first):
                yield from batches_of(fn(first))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                yield from batches_of(fn(part.slice(lo, hi - lo)))
            held = [part.slice(cuts[-1])]
        if held:
            yield from batches_of(fn(pa.concat_tables(held)))

    def batches_of(out: pa.Table | None) -> list[pa.RecordBatch]:
        return out.to_batches() if out is not None and len(out) else []

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def blocked(df: DataFrame, keys: list[str], size: int, salt: Column, a: str = "bi", b: str = "bj") -> DataFrame:
    """Splits groups of more than ``size`` rows into parts, and repeats every row for each
    pair of parts that its own belongs to, so that each pair of rows of a group meets:
    inside the task ``(keys, a, b)`` with ``a < b`` for rows of different parts, with
    ``a = b`` for rows of one.  ``own`` is the row's part.  Groups are counted with
    partial aggregates; a task never holds more than two parts."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(
        *keys, F.ceil(F.col("_n") / size).cast("int").alias("_k"))
    rows = df.join(many, keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(salt), F.col("_k")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return rows.withColumn(a, F.least("own", "_o")).withColumn(b, F.greatest("own", "_o")).drop("_o", "_k")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: ``(node, component)`` for every node that an
    edge names, ``component`` being the smallest node of its component.

    Alternating large-star and small-star rounds: each round hangs neighbours under
    the smallest one by decomposable ``min`` aggregates, so a node of any degree is
    pre-aggregated before the shuffle; the number of rounds grows with the logarithm
    of the longest path.  Every round is checkpointed to the shared folder; only the
    counts that tell whether anything changed reach the driver.
    """
    link = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    link = checkpoint(link)
    while True:
        # large-star: every larger neighbour hangs under the smallest of the closed neighbourhood
        both = link.select("u", "v").unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: the smaller neighbours of a node, and itself, hang under its smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        new = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = checkpoint(new)
        # a forest of stars, each root below its leaves, is the end: no node hangs under
        # two others, and no root hangs under another
        bad = (new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
               .unionByName(new.select("u").join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi")))
        done = bad.isEmpty()
        link = new
        if done:
            break
    leaves = link.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = link.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return leaves.unionByName(roots)


__all__ = ["table", "written", "fresh", "content_key", "per_group", "blocked", "forest", "connected_components",
           "checkpoint"]
