"""Token counts of whole texts, without materialising the documents' ids.

The piece model joins no white space to the characters before it, so a text falls apart
into pre-tokens, each a run of spaces with what follows up to the next space, that can be
counted alone.  In each block of documents the distinct pre-tokens are counted once, the
counts are joined to every document's pre-token frequencies, and the products are summed.

The join runs inside the block on purpose.  A table of all distinct pre-tokens grows with
the corpus, so it can't be broadcast, and joining it to the (document, pre-token) rows
would shuffle more bytes than the texts have.  A Python worker remembers a bounded number
of pre-tokens from block to block, so common ones are counted once for all its tasks.

Defined results: null and empty texts have 0 tokens; U+2581, the model's own sign for a
space, counts as one; repeated rows are counted each; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 4096

_BLOCK = 1 << 20  # characters whose pre-tokens are counted together
_MEMORY = 600_000  # pre-tokens that a worker remembers
_RUNS = re.compile("[ ▁]+[^ ▁]*")


class PieceCounts:
    """Numbers of pieces; the pre-tokens not met for longest are forgotten first."""

    def __init__(self, model: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    @staticmethod
    def frequencies(text: str) -> Counter:
        """How often each pre-token occurs; keys lack its first space, which the model adds."""
        if "  " in text or "▁" in text or text.startswith(" "):
            return Counter(run[1:].replace("▁", " ") for run in _RUNS.findall("▁" + text))
        return Counter(text.split(" "))

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        # a lone space is a piece, though the model gives none for an empty string
        return [len(ids) or 1 for ids in self.sp.encode(pre_tokens, num_threads=1)]

    def counts(self, block: list[str]) -> list[int]:
        freqs = [self.frequencies(t) if t else Counter() for t in block]
        met = set().union(*freqs)
        recent, older = self.recent.get, self.older.get
        known = {w: n for w in met if (n := recent(w) or older(w))}
        new = list(met.difference(known))
        known.update(zip(new, self.pieces(new)))
        self.recent.update(known)
        if len(self.recent) > _MEMORY // 2:
            self.recent, self.older = {}, self.recent
        get = known.__getitem__
        return [sum(map(mul, f.values(), map(get, f))) for f in freqs]

    def count_all(self, texts: Iterable[str | None]) -> list[int]:
        out: list[int] = []
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= _BLOCK:
                out += self.counts(block)
                block, size = [], 0
        return out + (self.counts(block) if block else [])


@lru_cache(maxsize=2)
def piece_counts(model: str) -> PieceCounts:
    """One per Python worker: tasks of a worker share it."""
    return PieceCounts(model)


def token_count(text: Column, model: str) -> Column:
    """The number of pieces of ``text`` by the sentencepiece model file, as a long."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(piece_counts(model).count_all(t.as_py() for t in texts), pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(count, "long")(text)
