"""Periodic runs of words, found as maximal pairs in an LCP-interval tree.

A *run* of period ``q`` is a stretch of consecutive words in which words ``q`` apart are
equal, ``q`` being the smallest such number, that no neighbouring word continues.  Two
suffixes that start ``q`` words apart, share exactly ``l`` words and have different words
to their left are a *maximal pair*: the stretch of ``q + l`` words from the first start on
has that period and can't be extended on either side.  So the pairs are the runs, and
nothing is extended.

For a block of whole texts the word suffixes are ordered by prefix doubling, in which only
suffixes that still share a prefix are sorted again, and common prefixes of neighbours
are read from the doubling ranks.  The LCP-interval tree is then walked bottom-up.  Each
interval holds its suffixes in order of position, every one with its class, the word to its
left; children are merged into the largest one.  Two suffixes of different children share
exactly the interval's number of words ``l``, so they are a maximal pair where their classes
differ, and a run where their distance ``q`` satisfies ``q * (exponent - 1) <= l`` and
``q + l >= length``.  Only neighbours in position can do so with the smallest period: a third
suffix between them would give the stretch a smaller one.  Intervals of prefixes too short
for any run are never built, nor are groups of suffixes whose closest starts are too far apart.

Texts are read whole and stay in their rows; nothing is shuffled.  A task holds a block of
some ``_BLOCK`` words, or one longer text, at about 100 bytes a word.

Defined results: null and empty texts, and those of white space, have no words and no runs
(``collapsed`` is null for null, else empty); each of several equal rows gets the same
result; all columns of the input pass through, whatever their names, and the result is one
struct column with the name given; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6  # words
MIN_EXPONENT = 4  # whole periods
WORD = r"[^\x20\x09-\x0D]+"  # what bytes.split() splits at, in a pattern

_BLOCK = 400_000  # words whose suffixes are ordered together


def suffix_order(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of ``first`` in order, and the rank of each by its first 1, 2, 4, ... symbols."""
    n = len(first)
    sa = np.argsort(first, kind="stable").astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = first[sa[1:]] != first[sa[:-1]]
    rank = np.full(n + 1, -1, dtype=np.int32)  # one more for the end
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of suffixes that aren't alone yet
    while len(slots):
        pos = sa[slots]
        key = rank[pos].astype(np.int64) * (n + 1) + rank[np.minimum(pos + step, n)] + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.copy())
        slots, step = slots[~(new & np.append(new[1:], True))], 2 * step
    return sa, levels


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``k`` where ``sa[k]`` and ``sa[k + 1]`` share ``least`` symbols or more, and how many."""
    start = min(least.bit_length() - 1, len(levels) - 1)
    at = np.flatnonzero(levels[start][sa[1:]] == levels[start][sa[:-1]])
    i, j = sa[at].copy(), sa[at + 1].copy()
    shared = np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        shared += step
        i += step
        j += step
    keep = shared >= least
    return at[keep], shared[keep]


def _runs_of(starts: list[int], lcps: list[int], left: list[int], length: int, exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs among suffixes in order, ``lcps`` between neighbours."""
    out: list[tuple[int, int, int]] = []

    def pair(i: int, j: int, lcp: int) -> None:
        q = j - i
        if q * (exponent - 1) <= lcp and q + lcp >= length and left[i] != left[j]:
            out.append((i, q + lcp, q))

    def merged(lcp: int, children: list[list[int]]) -> list[int]:
        children.sort(key=len)
        whole = children.pop()
        own = {x: k for k, child in enumerate(children) for x in child}
        if 8 * len(own) > len(whole):
            whole = sorted(chain(whole, own))
        else:
            for x in own:
                whole.insert(bisect_left(whole, x), x)
        for x, k in own.items():
            at = bisect_left(whole, x)
            if at and whole[at - 1] not in own:
                pair(whole[at - 1], x, lcp)
            if at + 1 < len(whole) and own.get(whole[at + 1]) != k:
                pair(x, whole[at + 1], lcp)
        return whole

    open_: list[tuple[int, list[list[int]]]] = []  # intervals on the path to the last suffix
    done = [starts[0]]
    for lcp, start in zip(lcps, starts[1:]):
        while open_ and open_[-1][0] > lcp:
            value, children = open_.pop()
            children.append(done)
            done = merged(value, children)
        if open_ and open_[-1][0] == lcp:
            open_[-1][1].append(done)
        else:
            open_.append((lcp, [done]))
        done = [start]
    while open_:
        value, children = open_.pop()
        children.append(done)
        done = merged(value, children)
    return out


def least_prefix(length: int, exponent: int) -> int:
    """Words that the suffixes of any run's pair share at least."""
    return min(max(length, exponent * q) - q for q in range(1, -(-length // exponent) + 1))


def find_runs(words: np.ndarray, bounds: np.ndarray, length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows ``(text, start, length, period)``, in order, for texts ``words[bounds[k]:bounds[k + 1]]`` of word numbers."""
    none = np.zeros((0, 4), dtype=np.int64)
    if len(words) < 2:
        return none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # words of different texts differ, so no prefix is shared across the end of a text
    sa, levels = suffix_order(text * (int(words.max()) + 1) + words)
    at, shared = common_prefixes(sa, levels, least_prefix(length, exponent))
    if not len(at):
        return none
    del levels
    # groups of neighbours in order: ``at`` is consecutive within one, which has one suffix more
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = at[1:] != at[:-1] + 1
    heads = np.flatnonzero(opens)
    sizes = np.diff(np.append(heads, len(at))) + 1
    longest = np.maximum.reduceat(shared, heads)
    group = np.repeat(np.arange(len(heads)), sizes)
    place = at[heads][group] + np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = sa[place]
    by = np.lexsort((starts, group))
    gap = np.diff(starts[by], prepend=starts[by][0])
    firsts = np.cumsum(sizes) - sizes
    gap[firsts] = np.iinfo(np.int64).max
    near = np.minimum.reduceat(gap, firsts)
    left = np.full(len(words), -1, dtype=np.int64)
    left[1:] = words[:-1]
    left[bounds[:-1][bounds[:-1] < len(words)]] = -1
    out = []
    for g in np.flatnonzero(near * (exponent - 1) <= longest):
        mine = starts[firsts[g]:firsts[g] + sizes[g]]
        of = dict(zip(mine.tolist(), left[mine].tolist()))
        out += _runs_of(mine.tolist(), shared[heads[g]:heads[g] + sizes[g] - 1].tolist(), of, length, exponent)
    if not out:
        return none
    found = np.array(out, dtype=np.int64)
    own = text[found[:, 0]]
    found = np.column_stack([own, found[:, 0] - bounds[own], found[:, 1:]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _blocks(texts: pa.Array) -> Iterator[list[tuple[bytes | None, list[bytes]]]]:
    rows, size = [], 0
    for t in texts:
        raw = t.as_py()
        words = raw.split() if raw else []
        if rows and size + len(words) > _BLOCK:
            yield rows
            rows, size = [], 0
        rows.append((raw, words))
        size += len(words)
    if rows:
        yield rows


def _block_runs(rows: list, length: int, exponent: int) -> pa.StructArray:
    sizes = np.array([len(words) for _, words in rows], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    coded = pa.array(list(chain.from_iterable(words for _, words in rows)), pa.large_binary()).dictionary_encode()
    found = find_runs(coded.indices.to_numpy().astype(np.int64), bounds, length, exponent)
    # a word goes if it lies behind the first period of a run
    cover = np.zeros(bounds[-1] + 1, dtype=np.int64)
    begins = bounds[found[:, 0]] + found[:, 1]
    np.add.at(cover, begins + found[:, 3], 1)
    np.add.at(cover, begins + found[:, 2], -1)
    stays = np.cumsum(cover)[:-1] == 0
    per_text = np.bincount(found[:, 0], minlength=len(rows))
    collapsed = []
    for k, (raw, words) in enumerate(rows):
        if per_text[k]:
            words = [w for w, s in zip(words, stays[bounds[k]:bounds[k + 1]].tolist()) if s]
        collapsed.append(None if raw is None else b" ".join(words))
    runs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), runs)
    return pa.StructArray.from_arrays([pa.array(sizes), listed, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                      ["n_words", "runs", "collapsed"])


def runs_of(text: Column, length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> Column:
    """``struct(n_words, runs: array(struct(start, length, period)), collapsed)`` of each text:
    runs by start, then period, of at least ``length`` words and ``exponent`` (2 or more) whole
    periods; ``collapsed`` has the words that lie behind no run's first period, joined by one space."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_block_runs(rows, length, exponent) for rows in _blocks(texts.cast(pa.binary()))]
            yield pa.concat_arrays(parts) if parts else _block_runs([], length, exponent)

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(found, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")(text)


def periodic_runs(docs: DataFrame, text_col: str = "text", name: str = "found", length: int = MIN_LENGTH,
                  exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with the struct column ``name`` of :func:`runs_of` (another column of that name is replaced)."""
    return docs.withColumn(name, runs_of(F.col(f"`{text_col}`"), length, exponent))
