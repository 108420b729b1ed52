"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte of a text goes if a string of ``LENGTH`` bytes that covers it also starts earlier:
in a document with a smaller id, or further up in the same one.  Matches never cross
documents and are judged on the input.

Suffixes are only compared where a repetition is possible:

1. Anchors.  Of every ``LENGTH`` bytes the ``GRAM``-byte string with the smallest hash is
   the anchor; equal strings have equal anchors, at the same place.  Consecutive starts with
   one anchor form a context: their bytes, at most ``2 * LENGTH - GRAM + 80`` of them.  Anchors
   are dealt by their hash; those that occur once are done.  Of contexts that are equal as
   a whole all but the first are repeated.
2. Transforms.  What is left, different contexts around one anchor, is cut into shards, and
   the Burrows-Wheeler transform of each shard is built: its symbols are strings of ``SYMBOL``
   bytes, so ``LENGTH / SYMBOL`` symbols span a match.
3. Merge.  The shards' transforms are interleaved as Holt and McMillan do: starting from
   shard after shard, the interleave is refined by sorting it stably by the transforms'
   symbols; after ``t`` rounds it is ordered by the first ``t`` symbols of all suffixes.  The
   suffixes themselves are never sorted again.  The round in which two neighbours part
   gives their common prefix; runs of neighbours that never part are the repeated
   intervals, and of the starts in each all but the first are repeated.

An anchor with more than ``GROUP`` different contexts is split exactly: its starts by their
distance to the anchor, eight at a time, and these by the bytes that all eight share.  Of the
pieces that are equal all but the first are repeated; where more than ``GROUP`` different ones
still share those bytes, each start is told apart by its own ``LENGTH`` bytes.  Copies of a
common passage are reduced to one in each block of texts before anything is shuffled, and anchors that
many texts share are dealt by their whole contexts, not by the anchor alone.

Defined results: a null text is empty, texts shorter than ``LENGTH`` stay whole; null ids come
last; of rows with the same id the one further up in the table is the earlier document; an
empty table gives an empty result; ids must be whole numbers (text ids raise an error); 2^63 - 1 stands
for a null id and is returned as null; other columns, whatever their names, are ignored.  Rows are numbered once, and written with their texts
compressed; every later pass reads that table, so a lost executor can't renumber them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import written

LENGTH = 100
GRAM = 20
SYMBOL = 25
GROUP = 20_000  # contexts of one anchor that are compared together
UNIT = 1 << 18  # bytes of contexts whose transforms are merged together
SHARDS = 4
BLOCK = 1 << 19  # bytes of text whose anchors are found together
SAMPLE = 64  # one text in so many is looked at for anchors that many texts share
HOT_SHARE = 1000
HOT_LEAST = 16

_PLACE = np.uint64(28)  # bits of a position in a block
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(b: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on."""
    word = np.concatenate([b, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    parts = {1: word}
    for k in (1, 2, 4):
        parts[2 * k] = parts[k][:-k] | (parts[k][k:] << np.uint64(8 * k))
    n, at, h = len(b) - size + 1, 0, None
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    for k in (8, 4, 2, 1):
        while size - at >= k:
            piece = parts[k][at:at + n]
            h = _mix(piece * _ODD) if h is None else _mix(h * _ODD + piece)
            at += k
    return h


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` hashes, the place of the smallest, the first of equal ones."""
    n = len(h)
    key = ((h >> _PLACE) << _PLACE) | np.arange(n, dtype=np.uint64)
    rows = -(-n // window)
    grid = np.full(rows * window, _MASK, dtype=np.uint64)
    grid[:n] = key
    grid = grid.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - window + 1
    low = np.minimum(back[:m], ahead[window - 1:window - 1 + m])
    return (low & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p, k = np.ones(1, dtype=np.uint64), 1
        while k < size:
            p, k = np.concatenate([p, p * np.uint64(pow(base, k, 1 << 64))]), 2 * k
        out.append(p)
    return out[0], out[1]


def contexts(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of texts of at least ``length`` bytes: the text's number, the first start in
    it, the number of starts, the anchor's distance, its hash, and a hash of all bytes."""
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = grams(b, gram)
    at = anchors(h, length - gram + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= ends[text])
    at, text = at[start], text[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(first, append=len(at))
    begin, place, text = start[first], at[first], text[first]
    up, down = _powers(1 << max(20, (len(b) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
    stop = begin + n - 1 + length
    whole = _mix((total[stop] - total[begin]) * down[begin] + (n * 512 + place - begin).astype(np.uint64))
    return text, begin - (ends - sizes)[text], n, place - begin, h[place], whole


# ``at``: first start, number of starts, distance of the anchor, and whether all starts are known to repeat
def _pack(start, n, off, known):
    return (start.astype(np.int64) << 17) | (n << 9) | (off << 1) | known


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 17, (at >> 9) & 255, (at >> 1) & 255


def find_contexts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(h, ch, doc, uid, at)`` of all contexts; of equal ones in a block all but the first are marked."""

    def rows(block: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        block.sort(key=lambda row: row[:2])
        text, start, n, off, h, ch = contexts([t for _, _, t in block], length, gram)
        doc, uid = np.array([d for d, _, _ in block])[text], np.array([u for _, u, _ in block])[text]
        h, ch, at = h.view(np.int64), ch.view(np.int64), _pack(start, n, off, 0)
        order = np.argsort(h ^ (ch * 3), kind="stable")  # equal contexts in the order of their documents
        same = (h[order][1:] == h[order][:-1]) & (ch[order][1:] == ch[order][:-1])
        later = np.concatenate([[False], same])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (
            h[order], ch[order], doc[order], uid[order], at[order] | later)], ["h", "ch", "doc", "uid", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, block, size = zstandard.ZstdDecompressor(), [], 0
        for b in batches:
            for doc, uid, data in zip(b.column("doc").to_pylist(), b.column("uid").to_pylist(), b.column("z")):
                text = z.decompress(data.as_buffer())
                if len(text) < length:
                    continue
                block.append((doc, uid, text))
                size += len(text)
                if size >= BLOCK:
                    yield rows(block)
                    block, size = [], 0
        if block:
            yield rows(block)

    return texts.mapInArrow(run, "h long, ch long, doc long, uid long, at long")


def common_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``h`` of anchors that hold more than one in ``HOT_SHARE`` of the contexts in one text of
    ``SAMPLE``: fewer than ``HOT_SHARE`` of them.  They only decide how rows are dealt."""
    some = find_contexts(texts.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0), length, gram)
    per = written(some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    least = max(HOT_LEAST, (per.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    return per.where(F.col("n") > least).select("h", F.lit(True).alias("hot"))


def settle(found: DataFrame, hot: DataFrame) -> DataFrame:
    """``(h, doc, uid, at)``: contexts marked as repeated, and those whose anchor has others
    to be compared with.  Contexts that nothing else shares the anchor of are gone.

    Marked rows are dealt by their document, the others by their anchor, one for each block
    of texts at most, and read as a sorted stream: a task holds one row.  Contexts of a ``hot`` anchor
    are dealt by all their bytes' hash, so that a passage in a third of all documents is spread
    over all tasks; the first of each kind is always left to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h, doc, uid, at):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, doc, uid, at)], ["h", "doc", "uid", "at"])

        held, last = None, None  # the last first context of an anchor, with whether there was one before; last (h, ch)
        for b in batches:
            h, ch, doc, uid, at = (b.column(c).to_numpy() for c in ("h", "ch", "doc", "uid", "at"))
            spread = b.column("hot").to_numpy(zero_copy_only=False)
            known = (at & 1) == 1
            if known.any():
                yield out(h[known], doc[known], uid[known], at[known])
            h, ch, doc, uid, at, spread = (x[~known] for x in (h, ch, doc, uid, at, spread))
            if not len(h):
                continue
            new = np.concatenate([[(h[0], ch[0]) != last], (h[1:] != h[:-1]) | (ch[1:] != ch[:-1])])
            last = (h[-1], ch[-1])
            yield out(h[~new], doc[~new], uid[~new], at[~new] | 1)
            yield out(*[x[new & spread] for x in (h, doc, uid, at)])
            fh, fdoc, fuid, fat = (x[new & ~spread] for x in (h, doc, uid, at))
            before = False
            if held is not None:
                *row, before = held
                fh, fdoc, fuid, fat = (np.concatenate([[v], x]) for v, x in zip(row, (fh, fdoc, fuid, fat)))
            if not len(fh):
                continue
            same = fh[1:] == fh[:-1]
            shared = np.concatenate([[before], same])
            open_ = shared.copy()
            open_[:-1] |= same
            held = (fh[-1], fdoc[-1], fuid[-1], fat[-1], bool(shared[-1]))
            open_[-1] = False  # decided by what follows
            yield out(fh[open_], fdoc[open_], fuid[open_], fat[open_])
        if held is not None and held[-1]:
            yield out(*[np.array([v]) for v in held[:-1]])

    known = F.col("at").bitwiseAND(F.lit(1)) == 1
    found = found.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = found.repartition(F.when(known, F.xxhash64("uid")).when(F.col("hot"), F.xxhash64("h", "ch")).otherwise(F.col("h")))
    return dealt.sortWithinPartitions("h", "ch", "doc", "uid", "at").mapInArrow(run, "h long, doc long, uid long, at long")


def compressed(texts: DataFrame) -> DataFrame:
    """``(uid, doc, z)``: texts as compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = [z.compress(t.as_buffer() or b"") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc"), pa.array(data, pa.binary())], ["uid", "doc", "z"])

    return texts.mapInArrow(run, "uid long, doc long, z binary")


def context_bytes(joined: DataFrame, length: int) -> DataFrame:
    """``(h, doc, uid, start, n, off, bytes)`` of the contexts listed in ``hs`` and ``ats`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            edges = b.column("ats").offsets.to_numpy()
            start, n, off = _unpack(b.column("ats").values.to_numpy()[edges[0]:edges[-1]])
            h, edges = b.column("hs").values.slice(edges[0], edges[-1] - edges[0]), edges - edges[0]
            row = np.repeat(np.arange(b.num_rows), np.diff(edges))
            lo = 0
            while lo < b.num_rows:  # some MB of contexts at a time
                hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 20_000, "right")) - 1)
                data = []
                for i in range(lo, hi):
                    text = z.decompress(b.column("z")[i].as_py())
                    at = slice(edges[i], edges[i + 1])
                    data += [text[s:s + k + length - 1] for s, k in zip(start[at].tolist(), n[at].tolist())]
                at, own = slice(edges[lo], edges[hi]), pa.array(row[edges[lo]:edges[hi]])
                yield pa.RecordBatch.from_arrays(
                    [h.slice(edges[lo], edges[hi] - edges[lo]), b.column("doc").take(own), b.column("uid").take(own), pa.array(start[at]),
                     pa.array(n[at].astype(np.int32)), pa.array(off[at].astype(np.int32)), pa.array(data, pa.binary())],
                    ["h", "doc", "uid", "start", "n", "off", "bytes"])
                lo = hi

    return joined.mapInArrow(run, "h long, doc long, uid long, start long, n int, off int, bytes binary")


def split_large(rows: DataFrame, group: int, length: int, gram: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with ``part`` and ``core``, at most ``group`` of each ``(h, part, core)``, and the
    ``(uid, start, n)`` found to repeat on the way.  Both are 0 but for anchors with more than
    ``group`` contexts.  Of those the starts at distances 8k to 8k + 7 from the anchor are part
    k + 1, told apart by the bytes that all eight share; every two equal strings stay together.
    Of pieces with equal bytes all but the first repeat.  Where more than ``group`` different
    pieces are left, each of their starts is decided by its own ``length`` bytes.  First ones
    are found by partial minima, so no task holds a group."""
    large = written(rows.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > group).select("h"), "large")
    none = [F.lit(0).cast("long").alias(c) for c in ("part", "core")]
    if large.isEmpty():
        return rows.select("h", *none, "doc", "uid", "start", "n", "bytes"), None
    small = rows.join(large, "h", "left_anti").select("h", *none, "doc", "uid", "start", "n", "bytes")
    cut = rows.join(large, "h").withColumn("k", F.explode(F.sequence(F.expr("(off - n + 1) div 8"), F.expr("off div 8"))))
    lo, hi = F.expr("greatest(0, off - 8 * k - 7)"), F.expr("least(n - 1, off - 8 * k)")
    cut = cut.select("h", (F.col("k") + 1).alias("part"),
                     F.xxhash64(F.expr(f"substring(bytes, int(off - 8 * k + 1), {length - 7})")).alias("core"),
                     "doc", "uid", (F.col("start") + lo).alias("start"), (hi - lo + 1).cast("int").alias("n"),
                     F.col("bytes").substr((lo + 1).cast("int"), (hi - lo + length).cast("int")).alias("bytes"))
    spot, keys, same = F.struct("doc", "uid", "start"), ["h", "part", "core"], ["h", "part", "core", "ba", "bb"]

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumns({"ba": F.xxhash64("bytes"), "bb": F.xxhash64(F.lit("second"), "bytes")})

    cut = written(hashed(cut), "pieces")
    firsts = written(cut.groupBy(*same).agg(F.min(spot).alias("lo")), "firsts")
    met = cut.join(firsts, same)
    found = met.where(spot != F.col("lo")).select("uid", "start", F.col("n").cast("long").alias("n"))
    left = met.where(spot == F.col("lo")).select(*keys, "doc", "uid", "start", "n", "bytes")
    many = written(firsts.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") > group).select(*keys), "many")
    if many.isEmpty():
        return small.unionByName(left), found
    single = left.join(many, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    single = hashed(single.select(*keys, "doc", "uid", (F.col("start") + F.col("i")).alias("start"),
                                  F.col("bytes").substr(F.col("i") + 1, F.lit(length)).alias("bytes"))).drop("bytes")
    single = written(single, "starts")
    again = single.join(single.groupBy(*same).agg(F.min(spot).alias("lo")), same).where(spot != F.col("lo"))
    return (small.unionByName(left.join(many, keys, "left_anti")),
            found.unionByName(again.select("uid", "start", F.lit(1).cast("long").alias("n"))))


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``key`` (not negative) and the keys in it."""
    bits = max(1, len(key) - 1).bit_length()
    if int(key.max(initial=0)) >> (63 - bits):  # too large to carry the place along
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << bits) | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


class Shard:
    """The Burrows-Wheeler transform of some contexts, with symbols of ``step`` bytes.

    ``place``: the places of its suffixes in their order; ``symbols``: the symbol in front of
    each, 0 where there is none; ``ends``: the symbols of the suffixes of one symbol, in order."""

    def __init__(self, symbol: np.ndarray, chain: np.ndarray, after: np.ndarray, before: np.ndarray, places: np.ndarray):
        c = chain[places] - chain[places].min()
        rank = symbol[places].astype(np.int64)
        low = int(c.max()) + 1  # the ends come first, each chain of symbols has its own
        index = np.full(len(symbol) + 1, -1, dtype=np.int64)
        index[places] = np.arange(len(places))
        hop = index[after[places]]  # after is len(symbol) at the end of a context
        while True:
            follow = np.where(hop >= 0, rank[hop] + low, c)
            order, key = _sorted(rank * (int(follow.max()) + 1) + follow)
            step_up = key[1:] != key[:-1]
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(step_up)])
            if step_up.all():
                break
            hop = np.where(hop >= 0, hop[hop], -1)
        self.place = places[order]
        front = before[self.place]
        self.symbols = np.where(front >= 0, symbol[front], 0)
        self.ends = symbol[self.place[after[self.place] == len(symbol)]]


def merge(shards: list[Shard], rounds: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all suffixes ordered by ``rounds`` symbols, and for each the bytes it has
    in common with the one in front, in whole symbols, up to ``rounds * step``."""
    sizes = [len(s.place) for s in shards]
    z = np.repeat(np.arange(len(shards), dtype=np.int8), sizes)  # the interleave
    block = np.zeros(len(z), dtype=np.int64)
    common = np.full(len(z), rounds * step, dtype=np.int64)
    end_z = np.concatenate([np.full(len(s.ends), i, dtype=np.int8) for i, s in enumerate(shards)])
    end_symbols = np.concatenate([s.ends for s in shards])
    for t in range(1, rounds + 1):
        symbols = np.empty(len(z), dtype=np.int64)
        for i, s in enumerate(shards):
            symbols[z == i] = s.symbols
        front = symbols > 0
        symbols = np.concatenate([end_symbols, symbols[front]])
        z = np.concatenate([end_z, z[front]])
        block = np.concatenate([np.zeros(len(end_z), dtype=np.int64), block[front] + (t > 1)])
        order, symbols = _sorted(symbols)
        z, block = z[order], block[order]
        parts = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])])
        common[parts & (common == rounds * step)] = (t - 1) * step
        block = np.cumsum(parts)
    places = np.empty(len(z), dtype=np.int64)
    for i, s in enumerate(shards):
        places[z == i] = s.place
    return places, common


def repeated_starts(data: list[bytes], n: np.ndarray, key: list[np.ndarray], length: int = LENGTH, step: int = SYMBOL,
                    shards: int = SHARDS) -> np.ndarray:
    """Of all starts (``n[i]`` in context ``i``), those whose ``length`` bytes start earlier too.

    ``key``: the (doc, uid, start) of each context.  Returned are rows of (context, start in it)."""
    b = np.frombuffer(b"".join(data), dtype=np.uint8)
    sizes = np.array([len(x) for x in data])
    begin = np.cumsum(sizes) - sizes
    ctx = np.repeat(np.arange(len(data)), sizes)
    inside = np.arange(len(b)) - begin[ctx]
    left = sizes[ctx] - inside
    symbol = np.zeros(len(b), dtype=np.int64)
    places = np.flatnonzero(left >= step)
    symbol[places] = np.unique(grams(b, step)[places], return_inverse=True)[1] + 1
    after = np.where(left >= 2 * step, np.arange(len(b)) + step, len(b))
    before = np.where(inside >= step, np.arange(len(b)) - step, -1)
    cuts = np.searchsorted(begin, np.linspace(0, len(b), shards + 1)[1:-1])
    groups = [g for g in np.split(places, np.searchsorted(ctx[places], cuts)) if len(g)]
    order, common = merge([Shard(symbol, ctx * step + inside % step, after, before, g) for g in groups], length // step, step)
    interval = np.cumsum(common < length)
    start = inside[order] < n[ctx[order]]
    order, interval = order[start], interval[start]
    doc, uid, first = key
    rank = np.empty(len(data), dtype=np.int64)  # stretches of starts don't overlap, so contexts order them
    rank[np.lexsort((first, uid, doc))] = np.arange(len(data))
    by, key = _sorted(interval * (len(data) << 8) + (rank[ctx[order]] << 8) + inside[order])
    again = np.concatenate([[False], np.diff(key // (len(data) << 8)) == 0])
    hit = order[by][again]
    return np.stack([ctx[hit], inside[hit]], axis=1)


def compare(rows: DataFrame, length: int) -> DataFrame:
    """``(uid, start, n)``: stretches of repeated starts found by merging transforms."""
    keys = ["h", "part", "core"]

    def unit(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        doc, uid, start = (t[c].to_numpy() for c in ("doc", "uid", "start"))
        hit = repeated_starts(t["bytes"].to_pylist(), t["n"].to_numpy(), [doc, uid, start], length)
        c, i = hit[:, 0], hit[:, 1]
        order = np.lexsort((i, c))
        c, i = c[order], i[order]
        new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1] + 1)])) if len(c) else c
        return pa.RecordBatch.from_arrays([pa.array(uid[c[new]]), pa.array(start[c[new]] + i[new]),
                                           pa.array(np.diff(new, append=len(c)))], ["uid", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            cols = [t[k].to_numpy() for k in keys]
            new = np.zeros(len(t), dtype=bool)
            for c, k in zip(cols, keys):
                new[1:] |= c[1:] != c[:-1]
                new[0] |= bool(held) and held[-1][k][-1].as_py() != c[0]
            sizes = np.cumsum(t["n"].to_numpy() + length - 1)
            at, done = 0, 0
            for cut in np.flatnonzero(new).tolist():
                upto = int(sizes[cut - 1]) if cut else 0
                if size + upto - done >= UNIT:
                    held.append(t.slice(at, cut - at))
                    yield unit(held)
                    held, size, at, done = [], 0, cut, upto
            held.append(t.slice(at))
            size += int(sizes[-1]) - done
        if held:
            yield unit(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "uid long, start long, n long")


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.select(F.monotonically_increasing_id().alias("uid"), order.alias("doc"), F.col(text_col).cast("binary").alias("text"))


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(uid, starts, counts)``: for each of the ``compressed`` texts with repeated strings the
    stretches of their starts."""
    settled = written(settle(find_contexts(texts, length, gram), common_anchors(texts, length, gram)), "settled")
    known = F.col("at").bitwiseAND(F.lit(1)) == 1
    opened = settled.where(~known).groupBy("uid").agg(F.collect_list(F.struct("h", "at")).alias("l")).select(
        F.col("uid").alias("u"), F.col("l.h").alias("hs"), F.col("l.at").alias("ats"))
    joined = texts.join(opened, F.col("uid") == F.col("u")).select("uid", "doc", "z", "hs", "ats")
    rows, cut = split_large(written(context_bytes(joined, length), "contexts"), group, length, gram)
    merged = compare(rows, length)
    if cut is not None:
        merged = merged.unionByName(cut)
    certain = settled.where(known).select("uid", F.expr("at >> 17").alias("start"), F.expr("(at >> 9) & 255").alias("n"))
    return (certain.unionByName(merged).groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("l"))
            .select("uid", F.col("l.start").alias("starts"), F.col("l.n").alias("counts")))


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
            group: int = GROUP, with_text: bool = False) -> DataFrame:
    """``(uid, id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and with
    ``with_text`` the bytes that are left as ``kept``."""
    texts = written(compressed(numbered(docs, id_col, text_col)), "texts")
    found = repeated(texts, length, gram, group).withColumnRenamed("uid", "u")
    rows = texts.join(found, F.col("uid") == F.col("u"), "left").select("uid", "doc", "z", "starts", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text, starts = z.decompress(b.column("z")[i].as_py()), b.column("starts")[i].as_py()
                gone, spans, kept = 0, 0, text
                if starts:
                    start = np.array(starts)
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], (start + np.array(b.column("counts")[i].as_py()) + length - 1)[order]
                    reach = np.maximum.accumulate(stop)
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                    lo, hi = start[new].tolist(), reach[np.append(new[1:], len(start)) - 1].tolist()
                    gone, spans = sum(hi) - sum(lo), len(lo)
                    kept = b"".join(text[x:y] for x, y in zip([0, *hi], [*lo, len(text)]))
                out.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out))
            arrays = [b.column("uid"), b.column("doc"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[4], pa.binary())] if with_text else []),
                                             names[:len(arrays) + with_text])

    names = ["uid", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "uid long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = rows.mapInArrow(run, schema + (", kept binary" if with_text else ""))
    return done.withColumn("id", F.when(F.col("id") < F.lit((1 << 63) - 1), F.col("id")))
