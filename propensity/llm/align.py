"""Alignment of two tokenizers over exact texts, each distinct text tokenised once.

Texts are shuffled whole, by the text itself, and counted: one row for each distinct text
with its number of copies.  Tokenizer A (byte-level BPE) encodes a space and the text,
tokenizer B (pieces, which adds that space itself) the text, and both are laid over the same
bytes.  Offsets where tokens of both end cut them into *groups*.  Between neighbouring ends of
either side lies exactly one overlap of an A token with a B token, a *link*, so links and
groups come from one merged list of ends.

An (A id, B id) pair counts in how many documents hold it linked.  Texts are taken in blocks of
some ``_BLOCK`` characters.  Each block lists its distinct pairs once, with the copies of the
texts that hold them as weights, and keeps, packed, which pairs each text holds how often.
Both go into one written table, so that a lost executor can't change what is in a block
between the two passes.  The blocks' pairs are summed over the corpus, the sums are joined back to
the blocks' pairs, and one task for each block turns them into the measures of its texts.  So
the shuffles carry a pair once per block, not once per text, and a pair of common words has no more
rows than there are blocks.

The measures are joined to the documents by the SHA-256 of the text.  A text with more than a
thousandth of all copies (at most a thousand such texts, hence a small broadcast) is dealt over
as many parts as that needs.

Defined results: texts that are null or empty, or whose tokens of either side don't join to
the same bytes, have no tokens: zeros, and an empty string for ``groups``.  Strings of special
tokens are plain text.  Repeated rows count as documents of their own; null ids stay null;
other columns, whatever their names, are ignored; an empty table gives an empty result.  A task
holds a block, or one longer text, at some 50 bytes a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import written
from propensity.llm.packing import TokenIds

_BLOCK = 4 << 20  # characters whose pairs are listed together
HOT_SHARE = 1000  # a text with more than one in so many documents is dealt over several tasks
HOT_LEAST = 10_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id, their lengths, and the decimal ids with either separator."""

    def __init__(self, entries: list[bytes], inner: str, last: str):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.printed = np.array([f"{i}{inner}" for i in range(len(entries))] + [f"{i}{last}" for i in range(len(entries))], dtype=object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class Aligner:
    """Both tokenizers; ``overlay`` lays them over one text."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None, model: str):
        import sentencepiece
        self.ids = TokenIds(tokenizer, ranks, pattern)
        self.ids.slow.encode_special_tokens = True
        letters = byte_letters()
        a = [b""] * (max(self.ids.slow.get_vocab().values(), default=-1) + 1)
        for token, i in self.ids.slow.get_vocab().items():
            a[i] = bytes(letters[c] for c in token)
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        b = [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
             for i in range(sp.get_piece_size())]
        self.a, self.b = Vocabulary(a, ",", "|"), Vocabulary(b, ",", ";")

    def overlay(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B, and for each end of a token: the number of A's and of B's token
        there, and which sides end there (1, 2, or 3 for both).  None if the bytes differ."""
        want = b" " + text.encode()
        a = np.frombuffer(self.ids(" " + text), "<u4").astype(np.int64)
        pieces = self.sp.encode(text, num_threads=1)
        if self.a.joined(a.tolist()) != want or self.b.joined(pieces) != want:
            return None
        b = np.array(pieces, dtype=np.int64)
        mark = np.zeros(len(want) + 1, dtype=np.uint8)
        mark[np.cumsum(self.a.sizes[a])] = 1
        mark[np.cumsum(self.b.sizes[b])] += 2
        sides = mark[np.flatnonzero(mark)]
        ends_a, ends_b = sides & 1, sides >> 1
        return a, b, np.cumsum(ends_a, dtype=np.int64) - ends_a, np.cumsum(ends_b, dtype=np.int64) - ends_b, sides

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, sides: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        both = sides == 3
        group = np.cumsum(both) - both
        done_a, done_b = (at_a + 1)[both], np.append(0, (at_b + 1)[both])
        is_a, is_b = (sides & 1) == 1, sides >= 2
        out = np.empty(len(a) + len(b), dtype=object)
        out[np.arange(len(a)) + done_b[group[is_a]]] = self.a.printed[a + len(self.a.sizes) * both[is_a]]
        out[np.arange(len(b)) + done_a[group[is_b]]] = self.b.printed[b + len(self.b.sizes) * both[is_b]]
        return "".join(out.tolist())[:-1].encode()


@lru_cache(maxsize=2)
def aligner(*files: str | None) -> Aligner:
    """One per Python worker: tasks of a worker share it."""
    return Aligner(*files)


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2^32: byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("key", pa.binary()), ("copies", pa.int64()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.binary()), ("weights", pa.binary()), ("n_pairs", pa.int64()),
    ("held", pa.binary()), ("times", pa.binary()), ("n_held", pa.list_(pa.int64()))])
_BLOCK_DDL = ("block long, place int, key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "pairs binary, weights binary, n_pairs long, held binary, times binary, n_held array<long>")


class _Block:
    """Rows of the texts of one block, and its last row, which holds the pairs."""

    def __init__(self, number: int):
        self.number, self.rows, self.codes, self.times, self.size = number, [], [], [], 0

    def add(self, al: Aligner, text: str, key: bytes, copies: int, digest: bool) -> None:
        self.size += len(text)
        laid = al.overlay(text)
        if laid is None:
            return
        a, b, at_a, at_b, sides = laid
        groups = al.groups(*laid)
        code, times = np.unique(a[at_a] << 32 | b[at_b], return_counts=True)
        self.codes.append(code)
        self.times.append(times)
        self.rows.append((key, copies, len(a), len(b), int((sides == 3).sum()), len(sides),
                          hashlib.sha256(groups).hexdigest() if digest else groups.decode()))

    def batch(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        n_held = np.array([len(c) for c in self.codes], dtype=np.int64)
        copies = np.array([r[1] for r in self.rows], dtype=np.int64)
        pairs, held = np.unique(np.concatenate(self.codes), return_inverse=True)
        weights = np.bincount(held, weights=np.repeat(copies, n_held)).astype(np.int64)  # exact below 2^53 copies
        first = np.cumsum(n_held) - n_held
        steps = np.diff(held, prepend=0)  # a text's pairs ascend
        steps[first] = held[first]
        rows = [{"block": self.number, "place": k, **dict(zip(("key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups"), r))}
                for k, r in enumerate(self.rows)]
        rows.append({"block": self.number, "place": -1, "pairs": pairs.tobytes(), "weights": weights.tobytes(), "n_pairs": len(pairs),
                     "held": pack_numbers(steps), "times": pack_numbers(np.concatenate(self.times)), "n_held": n_held.tolist()})
        yield from pa.Table.from_pylist(rows, _BLOCK_SCHEMA).to_batches()


def block_table(texts: DataFrame, files: tuple, digest: bool, block: int) -> DataFrame:
    """From ``key, text, copies``: a row for each text whose bytes agree, and one for each block."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, part, k = aligner(*files), TaskContext.get().partitionId() << 32, 0
        now = _Block(part)
        for batch in batches:
            for key, text, copies in zip(batch.column("key"), batch.column("text"), batch.column("copies")):
                now.add(al, text.as_py(), key.as_py(), copies.as_py(), digest)
                if now.size >= block:
                    yield from now.batch()
                    k += 1
                    now = _Block(part + k)
        yield from now.batch()

    return texts.mapInArrow(lay, _BLOCK_DDL)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, pairs, weights in zip(batch.column("block"), batch.column("pairs"), batch.column("weights")):
            p = np.frombuffer(pairs.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), number.as_py())), pa.array(p),
                                              pa.array(np.frombuffer(weights.as_py(), np.int64))], ["block", "pair", "n"])


_MEASURES = ["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups"]
_MEASURE_DDL = ("key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def _measure(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Measures of a block's texts from the corpus-wide counts of its pairs."""
    place = texts["place"].to_numpy()
    own = texts.take(pa.array([int(np.flatnonzero(place < 0)[0])]))
    texts = texts.take(pa.array(np.argsort(place, kind="stable")[1:]))
    order = np.argsort(counts["pair"].to_numpy(), kind="stable")
    n, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    n_held = np.array(own["n_held"][0].as_py(), dtype=np.int64)
    first = np.cumsum(n_held) - n_held
    total = int(n_held.sum())
    held = np.cumsum(unpack_numbers(own["held"][0].as_py(), total))
    held -= np.repeat(held[first] - unpack_numbers(own["held"][0].as_py(), total)[first], n_held)
    times = unpack_numbers(own["times"][0].as_py(), total)
    out = texts.select(_MEASURES)
    out = out.append_column("n_best", pa.array(np.add.reduceat(times * best[held], first)))
    return out.append_column("count_sum", pa.array(np.add.reduceat(times * n[held], first)))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair`` (A id times 2^32, and B id), ``count`` of documents, and ``best``: 1 where no
    pair of the A id has a higher count."""
    rows = blocks.where("place < 0").select("block", "pairs", "weights").mapInArrow(_block_pairs, "block long, pair long, n long")
    counts = written(rows.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("count").alias("top"))
    return counts.join(top, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, model: str, id_col: str = "doc_id",
          text_col: str = "text", digest: bool = False, block: int = _BLOCK) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of every document.

    ``n_best``: links whose pair has the highest count of its A id; ``count_sum``: the pairs'
    counts, summed over the links; ``groups``: ids by group, or with ``digest`` the lowercase
    hexadecimal SHA-256 of that string, which keeps the written table small.
    """
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = whole.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies")
    blocks = written(block_table(texts, (tokenizer, ranks, pattern, model), digest, block), "aligned")
    pairs = blocks.where("place < 0").select("block", "pairs", "weights").mapInArrow(_block_pairs, "block long, pair long, n long")
    counted = pairs.select("block", "pair").join(pair_counts(blocks), "pair").select("block", "pair", "count", "best")
    packed = blocks.select("block", "place", *_MEASURES, "held", "times", "n_held")
    measures = packed.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_measure, _MEASURE_DDL)
    measures = written(measures, "alignment")

    total = measures.agg(F.sum("copies")).first()[0] or 0
    share = max(HOT_LEAST, -(-total // HOT_SHARE))
    hot = measures.where(F.col("copies") > share).select("key", F.ceil(F.col("copies") / share).cast("int").alias("parts"))
    rows = whole.select("id", F.unhex(F.sha2("text", 256)).alias("key"))
    rows = rows.join(F.broadcast(hot), "key", "left").select(
        "id", "key", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    parts = F.when(F.col("copies") > share, F.ceil(F.col("copies") / share)).otherwise(1).cast("int")
    dealt = measures.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return rows.join(dealt, ["key", "part"], "left").select(
        "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("groups", F.lit("")).alias("groups"))
