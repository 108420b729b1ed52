"""Approximate nearest neighbours by cross-polytope hashing.

In each table a fast pseudo-rotation (three rounds of random signs and a Walsh-Hadamard
transform) turns the unit vectors, and a vector belongs to the signed axis that it lies
nearest to, that is to its largest coordinate in absolute value.  Where a table would have
more than ``BUCKET`` rows for each axis, the axes of several independent rotations are
joined to one bucket number, so buckets don't grow with the number of rows.  A query probes
the buckets nearest to it in every table; the rows it meets there are reranked by exact
cosine in double precision.  Every row is indexed, and every row is hashed once, into a written
table that the counts and both sides of the comparison read.

Queries are searched in passes, each of which reads only the queries that the one before left
open:

1. joined axes (only where one axis a bucket would be too few).  A query is settled where
   its ``k``-th cosine is so high that a nearer row would have been met with probability
   ``SURE``, by the hash's own collision rate at that cosine, measured on random pairs.
2. one axis a bucket, ``PROBES`` of them in every table: vectors without near neighbours have to
   meet a large share of all rows (a query of 64 dimensions meets about half of the unrelated ones).
3. queries that met fewer than ``k`` rows: all axes of one table, where every row is met.  So ``k``
   rows come back, or all there are.  Where rows are many, hardly a query gets here.

Buckets are compared in blocks of at most ``BLOCK`` rows with ``BLOCK`` queries, as matrix
products, and a task keeps each query's nearest rows only, so memory is bounded for buckets
of any size and no list of candidates is shuffled.

Recall depends on how near the true neighbours are.  With the default of 8 tables and 12
probes it is about 0.99 where the fifth neighbour of a 64-dimensional vector has a cosine
of only 0.45 (``tests/llm`` hold it to 0.9 against brute force); nearer neighbours are found
more surely.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part; only vectors of one length are compared; equal scores go by the smaller id;
rows with a null id are rows of one id, last in that order and returned as null; several rows
of one id are one candidate, with its best score, and one query; ids must be whole numbers
(others raise an error, as does a vector column that isn't an array); other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.llm.common import per_group, written
from propensity.llm.vectors import matrix, packed, unit, usable

TABLES = 8
PROBES = 12
NEAREST = 5
BLOCK = 2048
BUCKET = 4096  # rows for each bucket from which on a table joins another axis
SURE = 0.95
SEED = 11
ROUNDS = 3
_NO_ID = (1 << 63) - 1  # stands for a null id inside the search


class Rotation:
    """Pseudo-rotation of vectors of one length, padded to a power of two."""

    def __init__(self, dim: int, seed: int):
        self.size = 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng([seed, dim]).integers(0, 2, (ROUNDS, self.size)) * 2.0 - 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, :x.shape[1]] = x
        for signs in self.signs:
            y *= signs
            half = 1
            while half < self.size:
                pairs = y.reshape(len(y), -1, 2, half)
                y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), -1)
                half *= 2
            y /= np.sqrt(self.size)
        return y


def axes(x: np.ndarray, dim: int, table: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` signed axes nearest to each row (``2 * axis``, plus 1 where negative), nearest
    first, and the coordinates along them."""
    y = Rotation(dim, seed + table)(x)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    if count == 1:
        ax = both.argmax(axis=1)[:, None]
    else:
        ax = np.argpartition(-both, min(count, both.shape[1]) - 1, axis=1)[:, :count]
        ax = np.take_along_axis(ax, np.argsort(-np.take_along_axis(both, ax, axis=1), axis=1, kind="stable"), axis=1)
    return ax, np.take_along_axis(both, ax, axis=1)


def buckets(x: np.ndarray, dim: int, table: int, joined: int, probes: int, seed: int) -> np.ndarray:
    """Bucket numbers of each row, nearest first: ``probes`` combinations of ``joined`` axes."""
    size = 2 * Rotation(dim, 0).size
    codes, score = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for j in range(joined):
        ax, along = axes(x, dim, table + 1000 * j, probes, seed)
        codes = (codes[:, :, None] * size + ax[:, None, :]).reshape(len(x), -1)
        score = (score[:, :, None] + along[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
        codes, score = np.take_along_axis(codes, best, axis=1), np.take_along_axis(score, best, axis=1)
    return codes


def joined_axes(rows: int, dim: int, bucket: int) -> int:
    """Axes to join so that a table has a bucket for every ``bucket`` rows."""
    joined, size = 1, 2 * Rotation(dim, 0).size
    while rows > bucket * size ** joined and size ** (joined + 1) < 1 << 62:
        joined += 1
    return joined


@lru_cache(maxsize=64)
def sure_cosine(dim: int, joined: int, tables: int, probes: int, sure: float = SURE, seed: int = SEED) -> float:
    """The smallest cosine (in steps of 0.05) at which a row is met in some table with probability
    ``sure``: measured on 400 random pairs at each step; above 1 where no step reaches it."""
    rng = np.random.default_rng(seed)
    a = unit(rng.normal(size=(400, dim)))
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    if dim < 2 or not np.abs(side).max(axis=1).all():
        return 1.0
    side = unit(side)
    lowest = 1.05
    for cos in np.arange(0.95, 0.25, -0.05):
        b = cos * a + np.sqrt(1 - cos * cos) * side
        met = np.zeros(len(a), dtype=bool)
        for t in range(tables):
            met |= (buckets(a, dim, t, joined, probes, seed) == buckets(b, dim, t, joined, 1, seed)).any(axis=1)
        if met.mean() < sure:
            break
        lowest = float(cos)
    return lowest


def hashed(rows: DataFrame, tables: int, joined: dict[int, int], probes: int, seed: int) -> DataFrame:
    """``rows`` with ``buckets``: for each table the bucket of a row, or the ``probes`` of a query, in turn."""
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pa.Table.from_batches([b])
            dims = whole["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                t = whole.take(np.flatnonzero(dims == dim))
                u = unit(matrix(t["vec"], dim))
                found = np.concatenate([buckets(u, dim, k, joined.get(dim, 1), probes, seed) for k in range(tables)], axis=1)
                ends = np.arange(len(t) + 1, dtype=np.int32) * found.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield from t.append_column("buckets", lists).select([*names, "buckets"]).to_batches()

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, buckets array<long>")


def _nearest(k: int):
    def best(t: pa.Table) -> pa.Table | None:
        dim, is_query = t["dim"][0].as_py(), t["query"].to_numpy(zero_copy_only=False)
        q, x = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        if not len(q) or not len(x):
            return None
        ids = t["id"].to_numpy()
        qu, xu = unit(matrix(t["vec"].take(q), dim)), unit(matrix(t["vec"].take(x), dim))
        score = qu @ xu.T
        score[ids[q][:, None] == ids[x][None, :]] = -np.inf
        kth = np.partition(score, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
        # ties at the last place stay in: equal vectors may differ by rounding in the product
        a, b = np.nonzero((score >= kth[:, None] - 1e-12) & (score > -np.inf))
        exact = np.clip((qu[a] * xu[b]).sum(axis=1), -1.0, 1.0)
        order = np.lexsort((ids[x][b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < k
        return pa.table({"query_id": ids[q][a[top]], "dim": np.full(int(top.sum()), dim, dtype=np.int32), "id": ids[x][b[top]],
                         "score": exact[top]})
    return best


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _without(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Queries that ``found`` doesn't name."""
    named = found.select(F.col("query_id").alias("id"), "dim").distinct()
    return queries.join(named, ["id", "dim"], "left_anti")


def _met(index: DataFrame, queries: DataFrame, tables: int, probed: int, k: int, block: int) -> DataFrame:
    """The ``k`` nearest rows met by each query: ``(query_id, dim, id, score, rank)``.  ``buckets``
    holds the same number for each of the ``tables`` of the index, or ``probed`` tables of a query."""
    keys = ["dim", "t", "bucket"]

    def spread(side: DataFrame, n: int) -> DataFrame:
        at = side.select("id", "dim", "vec", F.size("buckets").alias("of"), F.posexplode("buckets").alias("at", "bucket"))
        return at.select("id", "dim", "vec", F.expr(f"int(at div (of div {n}))").alias("t"), "bucket")

    sides = {"x": spread(index, tables), "q": spread(queries, probed)}
    sizes = [side.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(f"k{name}")) for name, side in sides.items()]
    parts = sizes[0].join(sizes[1], keys)  # one row for each bucket that has rows and queries
    out = []
    for name, other in (("x", "q"), ("q", "x")):
        rows = sides[name].join(parts, keys)
        rows = rows.withColumn(f"b{name}", F.pmod(F.xxhash64("id"), F.col(f"k{name}")).cast("int"))
        rows = rows.withColumn(f"b{other}", F.explode(F.sequence(F.lit(0), F.col(f"k{other}") - 1)))
        out.append(rows.select("id", *keys, "vec", F.lit(name == "q").alias("query"), "bq", "bx"))
    met = per_group(out[0].unionByName(out[1]), [*keys, "bq", "bx"], _nearest(k), "query_id long, dim int, id long, score double")
    return _ranked(met.groupBy("query_id", "dim", "id").agg(F.max("score").alias("score")), ["query_id", "dim"], k)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST,
            tables: int = TABLES, probes: int = PROBES, block: int = BLOCK, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows found for each row that
    ``is_query`` holds for, among all rows with another id."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    if not isinstance(df.schema[vec_col].dataType, T.ArrayType):
        raise TypeError(f"{vec_col} must hold arrays of numbers")

    def side(rows: DataFrame) -> DataFrame:
        vectors = packed(rows, id_col, vec_col)
        return vectors.withColumn("id", F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)))

    sizes = df.where(usable(f"`{vec_col}`")).groupBy(F.size(f"`{vec_col}`").alias("dim")).agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("dim")).first()[0] or 1
    # lengths with more rows than a bucket for each axis: at most one in so many rows
    deep = {r["dim"]: j for r in sizes.where(F.col("n") > bucket).collect() if (j := joined_axes(r["n"], r["dim"], bucket)) > 1}
    rows, open_ = side(df), written(side(df.where(is_query)), "queries")
    found = []
    if deep:
        mine = F.col("dim").isin(*deep)
        index = written(hashed(rows.where(mine), tables, deep, 1, seed), "index")
        first = written(_met(index, hashed(open_.where(mine), tables, deep, probes, seed), tables, tables, k, block), "met")
        sure = F.create_map(*[F.lit(v) for dim, j in deep.items() for v in (dim, sure_cosine(dim, j, tables, probes))])
        settled = first.where((F.col("rank") == k) & (F.col("score") >= sure[F.col("dim")]))
        found.append(first)
        open_ = written(_without(open_, settled), "queries")
    if not deep or not open_.isEmpty():
        index = written(hashed(rows, tables, {}, 1, seed), "index")
        second = written(_met(index, hashed(open_, tables, {}, probes, seed), tables, tables, k, block), "met")
        found.append(second)
        every = 2 * Rotation(longest, 0).size
        short = written(_without(open_, second.where(F.col("rank") == k)), "queries")
        if probes < every and not short.isEmpty():
            found.append(_met(index, hashed(short, 1, {}, every, seed), tables, 1, k, block))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    if len(found) > 1 or sizes.count() > 1:  # a query may come from several passes, or an id have vectors of several lengths
        whole = _ranked(whole.groupBy("query_id", "id").agg(F.max("score").alias("score")), ["query_id"], k)
    named = [F.nullif(F.col(c), F.lit(_NO_ID)).alias(c) for c in ("query_id", "id")]
    return whole.select(named[0], "rank", named[1], "score")
