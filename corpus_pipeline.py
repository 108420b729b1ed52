"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet
in the shared checkpoint folder and read again as the next one's input.

Each stage works on all rows its predecessor kept and returns the columns of documents;
the last one returns the packed pieces.  SQL can't express the stages together (language
ID and tokenizers), so ``ORACLE_SQL`` is None and ``tests/llm`` hold the stages against
brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.llm import jaccard, langid, linededup, mixing, packing
from propensity.llm.common import fresh, table, written


COPIED = 0.8  # like the similarity of the stage after


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that resemble no language learned:
    ``und``, or a score below ``langid.MIN_SCORE``.  All other rows stay as they are, and all
    with a letter where no row could be learned from."""
    name, learned = fresh(docs, "language"), langid.learn(docs)
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, learned, name=name)
    return found.where((F.col(f"{name}.lang_pred") != langid.UNDETERMINED)
                       & (F.col(f"{name}.score") >= langid.MIN_SCORE)).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines and repeated lines of ``linededup.LINE_WORDS`` words or
    more (``n_chars`` follows).  A document of which nothing is left goes, and so does one that
    shared ``COPIED`` or more of its characters with earlier documents: it is a near copy, and its
    rest would be a stub that the next stage can't tell from an own text.  A document's own
    repeated lines don't count for that."""
    gone, copied = fresh(docs, "removed"), fresh(docs, "copied")
    left = linededup.dedup_lines(docs, n_removed=gone, n_copied=copied, line_words=linededup.LINE_WORDS)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")))
    stub = F.col(copied) * (1 - COPIED) >= F.length("text") * COPIED
    keep = (F.col(gone) == 0) | (F.col("text").rlike(r"[^ \t\n\x0B\f\r]") & ((F.col(copied) == 0) | ~stub))
    return left.where(keep).drop(gone, copied)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into token sequences: one row for each piece of a document."""
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
