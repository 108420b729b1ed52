"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies,
``rate = target / source_size`` (at most ``max_repeat``).  Prefix sums of the expected
copies run over the source's documents in a fixed order, one random offset ``u`` per
source is added, and a document is emitted once for every integer that its stretch of
the sum crosses.  Documents are ordered by size first, so the words taken come within
about one document of the target, not only their number.

Defined results: a null or empty text has size 0; a null ``source`` is a source of its
own, last in order; sources of size 0 have target 0; repeated rows are rows like any
other; rows of one id and size are told apart by a hash of all their columns; an empty table gives an
empty result.  Extra columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensity.llm.common import content_key, fresh, written
from propensity.operators.windows import prefix_sums

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BUCKETS = 64
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes in order, 32 classes for every doubling: at most 2,048 classes."""
    bits = F.length(F.bin(size))
    top = F.when(bits > 6, F.floor(size / F.pow(F.lit(2.0), (bits - 6).cast("double")))).otherwise(size)
    return (bits * 64 + top).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    All sizes together are shared by weight (``weights`` repeat over the sources in
    code-point order, null last); a target stops at ``max_repeat`` times its source's
    size and the excess is shared again by weight.  The end of that resharing is the
    level ``x`` with ``sum(least(cap, x * weight)) = total``, found from prefix sums over
    the sources in order of ``cap / weight``: no loop, and no task holds all sources.
    """
    w = F.array(*[F.lit(x) for x in weights])
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull()))
    ranked = prefix_sums(per, ["last", "source"], ["one"])
    caps = ranked.select("source", "source_size", "last",
                         F.get(w, (F.col("_before_one") % len(weights)).cast("int")).cast("long").alias("weight"),
                         (F.col("source_size") * max_repeat).alias("cap"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = prefix_sums(caps, ["ratio", "last", "source"], ["cap", "weight"])
    total = filled.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w"))
    level = (F.col("t") - F.col("_before_cap")) / (F.col("w") - F.col("_before_weight"))
    x = (filled.select("*", total.select("t").scalar().alias("t"), total.select("w").scalar().alias("w"))
         .withColumn("x", level).where("x <= ratio").agg(F.min_by("x", F.struct("ratio", "last", "source"))))
    return filled.select("source", "source_size",
                         F.least(F.col("cap").cast("double"), x.scalar() * F.col("weight")).alias("target"))


def _hashable(docs: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    return F.to_json(F.struct(col)) if "map<" in docs.schema[c].dataType.simpleString() else col


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, copies`` and ``row``, 128
    bits that stand for all its columns.

    The order inside a source is (size class, hash bucket, md5 of the id, id, size, row), so
    reruns agree, whole rows that are equal aside, and the prefix sum splits: rows are numbered
    inside (source, class, bucket), and the counts of those groups, at most 2,048 classes x 64
    buckets for a source, are summed in front.  A source with a third of all documents is thus
    spread over thousands of groups.
    """
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        word_count(F.col(text_col)).alias("size"), h.alias("h"),
                        content_key(*[_hashable(docs, c) for c in docs.columns]).alias("row"))
    narrow = written(sized, "sizes")  # texts are counted and hashed once, then only numbers are read
    rows = narrow.withColumn("cls", size_class(F.col("size"))).withColumn(
        "hb", F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % HASH_BUCKETS)
    targets = source_targets(narrow.select("source", "size"), weights, max_repeat)
    groups = rows.groupBy("source", "cls", "hb").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("cls", "hb").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    groups = groups.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("cls").alias("c"), F.col("hb").alias("b"), "off", "source_size", "target")
    inside = Window.partitionBy("source", "cls", "hb").orderBy("h", "id", "size", "row")
    rows = rows.withColumn("rn", F.row_number().over(inside) - 1)
    rows = rows.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("cls") == F.col("c"))
                     & (F.col("hb") == F.col("b")))
    tag = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    u = F.conv(F.substring(F.md5(tag), 1, 12), 16, 10).cast("double") / F.lit(float(2 ** 48))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    i = F.col("off") + F.col("rn")
    copies = F.least(F.floor((i + 1) * rate + u) - F.floor(i * rate + u), F.lit(max_repeat)).cast("int")
    return rows.select("id", "source", "size", "source_size", "target", copies.alias("copies"), "row")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    Copies are decided on the narrow plan and joined to the rows by 128 bits over all their
    columns, so texts are shuffled once, for this join.  Rows that are equal as a whole are
    interchangeable: one stands for all of them, with the sum of their copies."""
    key, n, m, copy = (fresh(docs, x) for x in ("key", "times", "equal", "copy"))
    plan = plan_mix(docs, **how).groupBy("row").agg(F.sum("copies").alias(n), F.count("*").alias(m)).where(F.col(n) > 0)
    plan = written(plan.select(F.col("row").alias(key), n, m), "copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("*", content_key(*[_hashable(docs, c) for c in docs.columns]).alias(key)).join(plan, key)
    once, several = rows.where(F.col(m) == 1), rows.where(F.col(m) > 1).dropDuplicates([key])
    taken = once if plan.where(F.col(m) > 1).isEmpty() else once.unionByName(several)
    return taken.select(*columns, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(copy)).drop(copy)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, length(bin(size)) AS bits, ('0x' || substr(h, 1, 2))::BIGINT % {HASH_BUCKETS} AS hb FROM d),
c AS (
  SELECT *, bits * 64 + CASE WHEN bits > 6 THEN size >> (bits - 6) ELSE size END AS cls FROM k),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, {MAX_REPEAT} * source_size AS cap, {MAX_REPEAT} * source_size / weight AS ratio FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS x FROM r
  WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(x, ratio) FROM f WHERE x <= ratio)) AS target,
         ('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'n')), 1, 12))::BIGINT / {2 ** 48}.0::DOUBLE AS u
  FROM r),
i AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, hb, h, doc_id, size) - 1 AS i FROM c),
e AS (
  SELECT i.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least({MAX_REPEAT}, floor((i + 1) * rate + u) - floor(i * rate + u)))::BIGINT AS taken
FROM e
"""
