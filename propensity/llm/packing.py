"""Packing of tokenised documents into sequences of fixed length, with certificates.

Each document becomes token ids and a closing id.  Only documents longer than a sequence
are cut: pieces of exactly the sequence length, the first one taking the remainder.  The
pieces are packed by best-fit decreasing inside partitions of a bounded number of pieces.
Dual feasible functions give a lower bound on the bins of each partition: where best fit
meets the bound, the partition is certified and closed.  Partitions with a gap keep their
full and nearly full bins and exchange the pieces of the others: these are dealt to fewer
partitions and packed again, until every partition is certified, one partition holds all
that is left, or an exchange saves no bin.

Texts are tokenised whole, one at a time, in a pass over the input without a shuffle; only
numbers go on from there.

Defined results: a null or empty text is the closing id alone; repeated rows are packed
once each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import written

SEQUENCE = 2048
CLOSING_ID = 0
GROUP = 50_000  # pieces that one task packs
ROUNDS = 8
TIGHT = 256  # a bin with less than a 256th of its room left isn't opened again

#: Texts with other characters, or with the opening of a special string, go through the
#: tokenizer itself, as do those with an unbroken run over ``_LONG`` characters.
_UNCOMMON = re.compile(r"[^\t-\r -~\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]|<\||\s{1000}")
_LONG = 1000


class TokenIds:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the file of the tokenizers library that defines them.  ``ranks`` is
    the same vocabulary as merge ranks: over common characters its encoder gives the same
    ids several times faster, so texts of these take it."""

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.slow, self.fast = Tokenizer.from_file(tokenizer), None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or _UNCOMMON.search(text) or max(map(len, text.split()), default=0) > _LONG:
            ids = np.array(self.slow.encode(text, add_special_tokens=False).ids)
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return ids.astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def token_ids(*files: str | None) -> TokenIds:
    """One per Python worker: tasks of a worker share it."""
    return TokenIds(*files)


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, closing: int = CLOSING_ID) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every document cut to sequence length."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([closing], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer, ranks, pattern)
        for batch in batches:
            doc, piece, starts, lengths, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):  # one text at a time: a batch may be tens of MB
                data = encode(text.as_py()) + end
                n, start, k = len(data) // 4, 0, 0
                stop = n % length or length
                while start < n:
                    doc.append(i)
                    piece.append(k)
                    starts.append(start)
                    lengths.append(stop - start)
                    crc.append(zlib.crc32(data[4 * start:4 * stop]))
                    start, stop, k = stop, stop + length, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray) -> int:
    """Bins that items need at least; ``counts[x]`` items have length ``x``, bins hold ``len(counts) - 1``.

    The largest bound of the dual feasible functions that, for a threshold ``e`` up to half
    a bin, round items above ``capacity - e`` up to a whole bin and drop those below ``e``.
    """
    cap = len(counts) - 1
    number = np.concatenate([[0], np.cumsum(counts)])  # of items shorter than x
    weight = np.concatenate([[0], np.cumsum(counts * np.arange(cap + 1))])
    e = np.arange(0, cap // 2 + 1)
    big = number[-1] - number[cap - e + 1]
    middle = weight[cap - e + 1] - weight[e]
    return int((big + -(-middle // cap)).max())


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and its offset there, and each bin's fill."""
    bins, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, fill = 0, []  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        fits = rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offset[i] = b, fill[b]
        fill[b] += x
        if r > x:
            open_bins[r - x].append(b)
            rooms |= 1 << (r - x)
    return bins, offset, np.array(fill, dtype=np.int64)


def _packer(capacity: int, base: int):
    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offset, fill = best_fit(lengths, capacity)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1))
        tight = fill[bins] >= capacity - capacity // TIGHT
        return pdf.assign(sequence_id=base + (pdf["part"].to_numpy() << 28) + bins, offset=offset, done=certified | tight)
    return pack_group


def pack(items: DataFrame, capacity: int = SEQUENCE, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Partitions are dealt by a row number that is written with the items, in order of length
    within each file, so that equal rows spread evenly; their count follows from the number of items.  Each round is
    written to the shared folder; the driver sees counts only.  A round that needs as many
    bins as before for what was exchanged is dropped, and the packing before it stays.
    """
    names = items.columns
    table = written(items.sortWithinPartitions("length").withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    full = table.where(F.col("length") == capacity)
    out = [full.select(*names, F.col("_uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = table.where(F.col("length") < capacity)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    left, before, bins = rest.count(), None, None
    for k in range(1, rounds + 1):
        parts = max(1, -(-left // group))
        # first in turn, in order of length, so that each partition gets the same mix; then at random
        turn = F.xxhash64(F.shiftright("_uid", 33)) % parts + F.col("_uid").bitwiseAND(F.lit((1 << 33) - 1))
        dealt = rest.select(*names, "_uid").withColumn(
            "part", F.pmod(turn if k == 1 else F.xxhash64("_uid", F.lit(k)), F.lit(parts)))
        packed = written(dealt.groupBy("part").applyInPandas(
            _packer(capacity, k << 56),
            f"{schema}, part long, sequence_id long, offset long, done boolean"), f"packed-{k}")
        need = packed.agg(F.count_distinct("sequence_id").alias("all"),
                          F.count_distinct(F.when(~F.col("done"), F.col("sequence_id"))).alias("open"),
                          F.count_if(~F.col("done")).alias("rows")).first()
        if before is not None and need["all"] >= bins:
            out.append(before.select(*names, "sequence_id", "offset"))
            break
        if parts == 1 or not need["rows"] or k == rounds:
            out.append(packed.select(*names, "sequence_id", "offset"))
            break
        out.append(packed.where("done").select(*names, "sequence_id", "offset"))
        rest = before = packed.where(~F.col("done"))
        left, bins = need["rows"], need["open"]
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
