"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine
verification, distributed connected components.

Equal vectors are one node with a multiplicity.  In each table a node's bucket is the sign
pattern of its products with random hyperplanes.  Buckets are compared in blocks: a task
holds at most two parts of ``BLOCK`` nodes, multiplies them as matrices in double precision,
and returns for each node the number of linked vectors and one link towards the smallest
node that it reaches, so a dense group of any size yields rows, not pairs.  A pair that
meets in several tables counts in the first one only.  Signatures are computed once, into a
written table; a row is shipped with its vector as wide as it was given and with the codes of
the tables up to its own, in as few bytes as the bits need.

Buckets hold about ``PER_BUCKET`` nodes whatever the number of rows: the bits grow with its
logarithm, and the number of tables with them, so that a pair exactly at the threshold is
missed with a probability below ``MISS`` (closer pairs far less often).

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different length link with nothing; rows with the same id
are one vector each, and links count rows; a component's id is the smallest that isn't null,
and null where all are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import blocked, connected_components, forest, per_group, written
from propensity.llm.vectors import matrix, packed, unit, usable

THRESHOLD = 0.95
MISS = 1e-4
PER_BUCKET = 64
BLOCK = 1024
SEED = 7


def plan_tables(rows: int, threshold: float = THRESHOLD, miss: float = MISS, per_bucket: int = PER_BUCKET) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    bits = max(4, min(60, round(math.log2(max(rows, 1) / per_bucket + 1))))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-same ** bits))


def code_width(bits: int) -> int:
    """Bytes that hold a sign pattern: 2, 4 or 8."""
    return 2 if bits <= 16 else 4 if bits <= 32 else 8


def signatures(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds ``codes``: one sign pattern for each table, ``code_width(bits)`` bytes each."""
    kind = f"<u{code_width(bits)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            t = pa.Table.from_batches([b])
            dims, codes = t["dim"].to_numpy(), np.empty(len(t), dtype=object)
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))
                own = np.flatnonzero(dims == dim)
                signs = matrix(t["vec"].take(own), dim) @ planes[dim] > 0
                for i, row in zip(own, signs.reshape(-1, tables, bits) @ weights):
                    codes[i] = row.astype(kind).tobytes()
            yield from t.append_column("codes", pa.array(codes.tolist(), pa.binary())).to_batches()

    return nodes.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema) + ", codes binary")


def _compare(threshold: float, width: int):
    def links(t: pa.Table) -> pa.Table | None:
        n = len(t)
        if n < 2:
            return None
        dim, table = t["dim"][0].as_py(), t["t"][0].as_py()
        order = np.argsort(t["node"].to_numpy(), kind="stable")
        node, m, own = (t[c].to_numpy()[order] for c in ("node", "m", "own"))
        u = unit(matrix(t["vec"].take(order), dim))
        codes = np.frombuffer(b"".join(t["codes"].take(order).to_pylist()), dtype=f"<u{width}").reshape(n, table + 1)
        near = np.triu(u @ u.T >= threshold, 1)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(near)
        for earlier in range(table):
            new = codes[a, earlier] != codes[b, earlier]
            a, b = a[new], b[new]
        if not len(a):
            return None
        links = np.bincount(a, m[b], minlength=n) + np.bincount(b, m[a], minlength=n)
        root, hit = forest(a, b, n), links > 0
        return pa.table({"node": node[hit], "links": links[hit].astype(np.int64), "root": node[root[hit]]})
    return links


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    miss: float = MISS, per_bucket: int = PER_BUCKET, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(id, n_links, component_id)`` for every row of ``df``."""
    vecs = packed(df, id_col, vec_col).withColumn("ka", F.xxhash64("vec")).withColumn("kb", F.xxhash64(F.lit("second"), "vec"))
    members = written(vecs.select("id", "ka", "kb"), "members")
    nodes = vecs.groupBy("ka", "kb").agg(F.count("*").alias("m"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits, tables = plan_tables(nodes.count(), threshold, miss, per_bucket)
    coded = written(signatures(nodes.select("node", "m", "dim", "vec"), bits, tables, seed), "signatures")
    width = code_width(bits)
    rows = coded.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    rows = rows.withColumn("code", F.xxhash64("dim", F.expr(f"substring(codes, {width} * t + 1, {width})")))
    rows = rows.withColumn("codes", F.expr(f"substring(codes, 1, {width} * (t + 1))"))  # those that tell earlier meetings
    rows = blocked(rows, ["t", "code"], block, F.col("node"))
    found = written(per_group(rows, ["t", "code", "bi", "bj"], _compare(threshold, width),
                              "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("node <> root"), "node", "root")
    label = (nodes.select("node", "ka", "kb", "m").join(links, "node", "left").join(comp, "node", "left")
             .withColumn("component", F.coalesce("component", "node"))
             .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("m") - 1))
    tagged = members.join(label.drop("m", "node"), ["ka", "kb"])
    smallest = tagged.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = tagged.join(smallest, "component").select("id", F.col("links").alias("n_links"), "component_id")
    alone = df.where(f"not ({usable(f'`{vec_col}`')})").select(
        F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.unionByName(alone)
