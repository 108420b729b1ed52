"""N-gram Jaccard join of documents with Bayesian candidate pruning.

A document is the set of its runs of five words (words are what ASCII white space
separates; a shorter text is one run of all its words).  Documents with equal sets are one
node with a multiplicity.

1. Every node gets ``HASHES`` MinHash values; nodes that share a band of ``ROWS`` values
   meet in a bucket.  At a similarity of 0.8 a pair shares none of the 24 bands with a
   probability of 3e-6.  Buckets with the same members are kept once.
2. Inside a bucket pairs are compared ``STEP`` values at a time.  With a uniform prior the
   similarity after ``m`` agreements in ``n`` values has the posterior Beta(m + 1, n - m + 1);
   a pair is dropped as soon as its probability of reaching the threshold falls below
   ``TOLERANCE``.  Survivors are only kept as links towards the smallest node reached.
3. Components of survivors bring their texts together, and all pairs of a component are
   verified exactly by counting common runs as matrix products.  Pairs are counted and
   linked, not listed: a group of thousands of near copies yields one row for each.

Buckets and components beyond ``BLOCK`` nodes are split into pairs of parts, so a task
holds two parts at most.  Nothing is capped and no candidate is dropped but by its posterior.

Defined results: null texts and texts without a word link with nothing, each is a class of
its own; repeated rows and equal texts are copies and count as links; the class id is the
smallest id of the class; rows with a null id are classed, and come last in that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import blocked, connected_components, forest, fresh, per_group, written

N = 5
THRESHOLD = 0.8
HASHES = 96
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
SEED = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 4096  # runs hashed together
_COLUMNS = 2048  # runs multiplied together


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Shingles:
    """Sets of hashed word runs of texts."""

    def __init__(self, n: int = N, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.n = n
        self.base = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.place = (rng.integers(1 << 62, size=n + 1).astype(np.uint64) << np.uint64(1)) + np.uint64(1)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, size: int) -> None:
        while len(self.up) < size:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(int(self.base), k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(int(self.inverse), k, 1 << 64))])

    def words(self, text: str) -> np.ndarray:
        """A 64-bit hash for each word: its polynomial over the bytes."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        gap = _SPACE[b]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return np.empty(0, dtype=np.uint64)
        self._powers(len(b) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:len(b)])])
        return _mix((total[stop] - total[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct runs."""
        w = self.words(text) if text else np.empty(0, dtype=np.uint64)
        if not len(w):
            return w
        n = min(self.n, len(w))
        x = np.full(len(w) - n + 1, self.place[n - 1] if n < self.n else np.uint64(0))
        for k in range(n):
            x = x + w[k:len(w) - n + 1 + k] * self.place[k + 1]
        return np.unique(_mix(x))


def minhash(x: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), _CHUNK):
        part = (x[lo:lo + _CHUNK] >> np.uint64(32)).astype(np.uint32)
        np.minimum(out, (mul[:, None] * part[None, :] + add[:, None]).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, hashes: int, seed: int) -> DataFrame:
    """``(id, th, ka, kb, sig)``: the key of the set and its MinHash values; no row for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(n, seed)
        rng = np.random.default_rng([seed, 1])
        mul = rng.integers(1 << 31, size=hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        add = rng.integers(1 << 32, size=hashes, dtype=np.uint32)
        for b in batches:
            keep, ka, kb, sig = [], [], [], []
            for i, text in enumerate(b.column("text")):
                x = sets(text.as_py())
                if len(x):
                    keep.append(i)
                    odd = x * np.uint64(0x9E3779B97F4A7C15)
                    ka.append(int(np.bitwise_xor.reduce(odd ^ (odd >> np.uint64(29)))) - (1 << 63))
                    kb.append(int(x.sum(dtype=np.uint64)) - (1 << 63))
                    sig.append(minhash(x, mul, add).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep, pa.int64())),
                                              b.column("th").take(pa.array(keep, pa.int64())), pa.array(ka, pa.int64()),
                                              pa.array(kb, pa.int64()), pa.array(sig, pa.binary())],
                                             ["id", "th", "ka", "kb", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, th long, ka long, kb long, sig binary")


def least_agreements(threshold: float, hashes: int, step: int, tolerance: float) -> dict[int, int]:
    """For ``n`` values compared, the fewest agreements that keep a pair: the posterior
    P(Beta(m + 1, n - m + 1) >= t) equals P(Binomial(n + 1, t) <= m)."""
    out = {}
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _prune(least: dict[int, int]):
    def survivors(t: pa.Table) -> pa.Table | None:
        order = np.argsort(t["node"].to_numpy(), kind="stable")
        node, own = t["node"].to_numpy()[order], t["own"].to_numpy()[order]
        sig = np.frombuffer(b"".join(t["sig"].take(order).to_pylist()), dtype="<u4").reshape(len(node), -1)
        a, b = np.triu_indices(len(node), 1)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            cross = own[a] != own[b]
            a, b = a[cross], b[cross]
        agree, done = np.zeros(len(a), dtype=np.int32), 0
        for n, m in least.items():
            agree = agree + (sig[a, done:n] == sig[b, done:n]).sum(axis=1, dtype=np.int32)
            alive = agree >= m
            a, b, agree, done = a[alive], b[alive], agree[alive], n
        if not len(a):
            return None
        root = forest(a, b, len(node))
        leaf = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[leaf], "b": node[root[leaf]]})
    return survivors


def _verify(n: int, seed: int, threshold: float):
    sets: list[Shingles] = []

    def links(t: pa.Table) -> pa.Table | None:
        if not sets:
            sets.append(Shingles(n, seed))
        order = np.argsort(t["node"].to_numpy(), kind="stable")
        node, own, m = (t[c].to_numpy()[order] for c in ("node", "own", "m"))
        size = len(node)
        runs = [sets[0](x) for x in t["text"].take(order).to_pylist()]
        count = np.array([len(x) for x in runs])
        _, col, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(size), count)
        shared = times[col] > 1  # a run of one document is in no intersection
        row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
        by_col = np.argsort(col, kind="stable")
        row, col = row[by_col], col[by_col]
        common = np.zeros((size, size), dtype=np.float64)
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
            i, j = np.searchsorted(col, [lo, lo + _COLUMNS])
            has = np.zeros((size, _COLUMNS), dtype=np.float32)
            has[row[i:j], col[i:j] - lo] = 1
            common += has @ has.T
        union = count[:, None] + count[None, :] - common
        near = np.triu(common >= threshold * union - 1e-9, 1)
        if t["bi"][0].as_py() != t["bj"][0].as_py():
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return None
        total = np.bincount(a, m[b], minlength=size) + np.bincount(b, m[a], minlength=size)
        root, hit = forest(a, b, size), total > 0
        return pa.table({"node": node[hit], "links": total[hit].astype(np.int64), "root": node[root[hit]]})
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N,
                 hashes: int = HASHES, rows: int = ROWS, step: int = STEP, tolerance: float = TOLERANCE,
                 block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(id, th, n_links, class_id, kept)`` for every row: ``th`` is a hash of the text,
    ``n_links`` the number of other rows at the threshold or above, ``kept`` marks the row of
    each class with the smallest id (of equal ids, the smallest hash)."""
    sketched = written(sketches(docs, id_col, text_col, n, hashes, seed), "sketches")
    nodes = sketched.groupBy("ka", "kb").agg(F.count("*").alias("m"), F.min(F.struct(F.col("id").isNull(), "id", "th")).alias("rep"),
                                             F.first("sig").alias("sig"))
    nodes = written(nodes.select("ka", "kb", "m", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "sig")
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(hashes // rows - 1)),
        lambda k: F.xxhash64(k, F.expr("sig").substr(k * (4 * rows) + 1, F.lit(4 * rows))))).alias("key"))
    # buckets with the same members, told by their number and combined hash, are kept once
    members = bands.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("s"),
                                       F.min("node").alias("lo"), F.max("node").alias("hi")).where("c > 1")
    buckets = members.groupBy("c", "s", "lo", "hi").agg(F.min("key").alias("key")).select("key")
    met = bands.join(buckets, "key").join(nodes.select("node", "sig"), "node")
    met = blocked(met, ["key"], block, F.col("node"))
    least = least_agreements(threshold, hashes, step, tolerance)
    survivors = per_group(met, ["key", "bi", "bj"], _prune(least), "a long, b long")
    comp = written(connected_components(survivors), "candidates")
    # texts of the candidates, one for each distinct set
    who = nodes.join(comp, "node").select("node", "m", "component", F.col("id").alias("i"), F.col("th").alias("h"))
    text = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text = text.join(who, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("node", "m", "component", "text")
    text = text.dropDuplicates(["node"])
    found = written(per_group(blocked(text, ["component"], block, F.col("node")), ["component", "bi", "bj"],
                              _verify(n, seed, threshold), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("node <> root"), "node", "root").withColumnRenamed("component", "class")
    label = (nodes.select("node", "ka", "kb", "m").join(links, "node", "left").join(classes, "node", "left")
             .select("ka", "kb", F.coalesce("class", "node").alias("class"),
                     (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    tagged = sketched.select("id", "th", "ka", "kb").join(label, ["ka", "kb"])
    first = tagged.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    tagged = tagged.join(first, "class").select(
        "id", "th", "n_links", F.col("first.id").alias("class_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))).alias("kept"))
    wordless = docs.where(F.coalesce(~F.col(text_col).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(True))).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.lit(0).cast("long").alias("n_links"),
        F.col(id_col).alias("class_id"), F.lit(True).alias("kept"))
    return tagged.unionByName(wordless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: of rows with the same id and text, one."""
    th, key = fresh(docs, "th"), fresh(docs, "key")
    own = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    kept = near_classes(docs, id_col, text_col, **how).where("kept").select(own("id").alias(key), F.col("th").alias(th)).distinct()
    rows = docs.withColumn(th, F.xxhash64(text_col)).withColumn(key, own(id_col))
    return rows.join(kept, [key, th]).dropDuplicates([key, th]).select(*[F.col(f"`{c}`") for c in docs.columns])
