"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from a generator seeded with its code
point, so any alphabet is covered and all executors agree).  An n-gram vector binds the
letters of the n-gram: the product of their vectors, each permuted (rolled) by its place.
A document's vector bundles (sums) its n-gram vectors; a language's prototype bundles the
documents of its training rows; the prediction is the prototype of largest cosine.

Texts are lower-cased, every run of other characters than letters counts as one space.

Learning reads a bounded sample of the labelled rows: about ``MAX_TRAIN_DOCS`` whole texts
of each language, drawn by a hash of the id.  Vectors of learning rows are summed as
integers in Spark, so prototypes don't depend on the order of rows; the driver receives
``DIM`` numbers for each language and nothing else.  Prediction is one pass over whole
texts without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text when no row could be learned from; ties go to the first language in code-point order;
the score is the cosine, 0 where it is negative.  A null id counts as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
NGRAM = 3
MAX_TRAIN_DOCS = 4000
MIN_SCORE = 0.03  # about what two unrelated vectors of 1,024 components reach
UNDETERMINED = "und"
SEED = 20260

_CHUNK = 400_000  # characters that are counted together
_DENSE = 1 << 22  # n-gram codes that a look-up table may hold


class Encoder:
    """Bundled n-gram vectors of texts."""

    def __init__(self, dim: int = DIM, n: int = NGRAM, seed: int = SEED):
        self.dim, self.n, self.seed = dim, n, seed
        self.alpha = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=bool)
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = (bits * 2 - 1).astype(np.int8)
        return self.letters[code]

    def codes(self, text: str) -> np.ndarray:
        """Letters as code points, runs of others as one space; empty if there is no letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.alpha[c]
        if not is_letter.any():
            return c[:0]
        c = np.where(is_letter, c, 32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        return np.concatenate([[32], c[keep], [32] if is_letter[-1] else []]).astype(np.int64)

    def bundle(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row for each code sequence (all non-empty)."""
        alphabet, flat = np.unique(np.concatenate(texts), return_inverse=True)
        size = len(alphabet)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        m = len(flat) - self.n + 1
        key = np.zeros(m, dtype=np.int64)
        for k in range(self.n):
            key = key * size + flat[k:m + k]
        inside = doc[:m] == doc[self.n - 1:]
        key, doc = key[inside], doc[:m][inside]
        if size ** self.n <= _DENSE:
            there = np.zeros(size ** self.n, dtype=bool)
            there[key] = True
            grams = np.flatnonzero(there)
            place = np.empty(size ** self.n, dtype=np.int64)
            place[grams] = np.arange(len(grams))
            col = place[key]
        else:
            grams, col = np.unique(key, return_inverse=True)
        base = np.stack([self.letter(int(c)) for c in alphabet])
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for lo in range(0, len(grams), 8192):  # a bounded piece of n-gram vectors at a time
            part = grams[lo:lo + 8192]
            vec, rest = np.ones((len(part), self.dim), dtype=np.int8), part
            for k in range(self.n):
                vec *= np.roll(base, k, axis=1)[rest % size]
                rest = rest // size
            own = (col >= lo) & (col < lo + len(part)) if len(grams) > 8192 else slice(None)
            counts = np.bincount(doc[own] * len(part) + col[own] - lo, minlength=len(texts) * len(part))
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ vec.astype(np.float32)
        return out

    def blocks(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Rows of texts with a letter, and their vectors, a bounded number of characters at a time."""
        rows, own, size = [], [], 0
        for i, t in enumerate(texts):
            c = self.codes(t) if t else None
            if c is None or not len(c):
                continue
            rows.append(i)
            own.append(c)
            size += len(c)
            if size >= _CHUNK:
                yield rows, self.bundle(own)
                rows, own, size = [], [], 0
        if rows:
            yield rows, self.bundle(own)


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is a multiple of 5: never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs: int = MAX_TRAIN_DOCS, dim: int = DIM, n: int = NGRAM) -> dict[str, np.ndarray]:
    """Prototype of each language, from rows that aren't held out."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    grid = 1 << 24
    rate = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(grid, -(-grid * max_docs // c)))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(grid)) < rate[F.col("lang")])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = Encoder(dim, n), {}
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            for own, vec in enc.blocks(t.as_py() for t in b.column("text")):
                for lang in set(langs[own]):
                    total[lang] = total.get(lang, 0) + vec[langs[own] == lang].sum(axis=0)
        for lang, vec in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)),
                                              pa.array(np.rint(vec).astype(np.int64))], ["lang", "i", "v"])

    got = drawn.select("text", "lang").mapInArrow(sums, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    prototypes: dict[str, np.ndarray] = {}
    for r in got:
        prototypes.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["v"]
    return {lang: prototypes[lang] for lang in sorted(prototypes)}


def predict(prototypes: dict[str, np.ndarray], dim: int = DIM, n: int = NGRAM):
    """Column function: text -> struct(lang_pred, score)."""
    langs = list(prototypes)
    proto = np.stack([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in langs]) if langs else None

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = Encoder(dim, n)
        for texts in batches:
            lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
            if proto is not None:
                for own, vec in enc.blocks(t.as_py() for t in texts):
                    cos = vec @ proto.T / np.maximum(np.linalg.norm(vec, axis=1), 1e-12)[:, None]
                    best = cos.argmax(axis=1)
                    lang[own] = np.array(langs, dtype=object)[best]
                    score[own] = np.clip(cos[np.arange(len(own)), best], 0.0, 1.0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "lang_pred string, score double")


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` and a struct column ``name`` with ``lang_pred`` and ``score``."""
    return docs.withColumn(name, predict(prototypes)(F.col(text_col)))
