"""Data-profiling aggregates over the loaded leads and the event log.

Each function is a single pass (or a pass plus a bounded post-aggregate); top-k
per column is computed hierarchically so a high-cardinality column never sends
all its distinct values to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.constants import EVENT_TYPES


def count_by(df: DataFrame, col: str) -> DataFrame:
    """COUNT(*) per value, largest first (the ordering is a presentation detail)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


def any_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows where at least one of ``cols`` is present."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else cond | F.col(c).isNotNull()
    return df.where(cond)


def null_percentages_long(df: DataFrame, cols: list[str], decimals: int = 2) -> DataFrame:
    """(column_name, null_pct): 100 * NULL share, rounded half-up, largest first."""
    n = F.count(F.lit(1))
    wide = df.agg(*[F.round(F.lit(100.0) * F.count_if(F.col(c).isNull()) / n, decimals).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_pct").orderBy(F.desc("null_pct"), "column_name")


def top_k_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """At most ``k`` rows per ``group`` by ``order``, with their ``rank``.  The optimizer
    limits each task to ``k`` rows of a group before the exchange (window group limit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """(column_name, value, count, rank): the ``k`` most frequent non-null values per
    column (ties by value)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("s"))
    counts = (stacked.select("s.column_name", "s.value").where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    return top_k_per_group(counts, "column_name", [F.desc("count"), F.asc("value")], k)


def conversion_overall(df: DataFrame, label: str = "converted") -> DataFrame:
    """total, converted_count, conversion_rate_pct (2 decimals; unknown labels count
    in the denominator only)."""
    n = F.count(F.lit(1))
    conv = F.count_if(F.coalesce(F.col(label), F.lit(False)))
    return df.agg(n.alias("total"), conv.alias("converted_count"),
                  F.round(F.lit(100.0) * conv / n, 2).alias("conversion_rate_pct"))


def conversion_by(df: DataFrame, by: str, k: int | None = 15, label: str = "converted") -> DataFrame:
    """Per non-null ``by`` value: conversion_rate_pct and total; best ``k`` by rate
    (ties by value)."""
    n = F.count(F.lit(1))
    conv = F.count_if(F.coalesce(F.col(label), F.lit(False)))
    out = (df.where(F.col(by).isNotNull()).groupBy(by)
           .agg(F.round(F.lit(100.0) * conv / n, 2).alias("conversion_rate_pct"), n.alias("total")))
    out = out.orderBy(F.desc("conversion_rate_pct"), F.asc(by))
    return out.limit(k) if k else out


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise-complete rows), long form
    (var_a, var_b, corr); all pairs come from one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    agg = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs],
                 *[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])
    cells = []
    for a, b in pairs:
        v = F.col(f"{a}__{b}")
        cells += [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), v.alias("corr")),
                  F.struct(F.lit(b).alias("var_a"), F.lit(a).alias("var_b"), v.alias("corr"))]
    for c in cols:
        one = F.when(F.col(f"_sd_{c}") > 0, F.lit(1.0))
        cells.append(F.struct(F.lit(c).alias("var_a"), F.lit(c).alias("var_b"), one.alias("corr")))
    return agg.select(F.explode(F.array(*cells)).alias("c")).select("c.var_a", "c.var_b", "c.corr")


def histogram(df: DataFrame, cols: list[str], bins: int = 40) -> DataFrame:
    """Equal-width histogram per column over [min, max] (last bin closed; a constant
    column spans [v - 0.5, v + 0.5]); NULLs dropped.  Long form with every bin:
    (column_name, bin, bin_lo, bin_hi, count)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")) \
        .select("s.*").where(F.col("v").isNotNull())
    stats = stacked.groupBy("column_name").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    lo = F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn"))
    hi = F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx"))
    stats = stats.select("column_name", lo.alias("lo"), hi.alias("hi"))
    # stats has one row per column: a bounded broadcast
    idx = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))).cast("int")
    binned = stacked.join(F.broadcast(stats), "column_name").select(
        "column_name", F.least(idx, F.lit(bins - 1)).alias("bin"))
    counts = binned.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = stats.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["column_name", "bin"], "left")
            .select("column_name", "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def events_by_type(events: DataFrame, types=EVENT_TYPES) -> DataFrame:
    """(event_type, count, pct): every known type, zero-filled, with % of all events."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    known = events.sparkSession.createDataFrame([(t,) for t in types], "event_type string")
    joined = F.broadcast(known).join(counts, "event_type", "left")
    total = F.sum(F.coalesce(F.col("n"), F.lit(0))).over(Window.partitionBy(F.lit(1)))
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.select("event_type", n.alias("count"),
                         F.when(total > 0, n / total * F.lit(100.0)).otherwise(F.lit(0.0)).alias("pct"))


def class_balance(df: DataFrame, label: str = "converted") -> DataFrame:
    """n_neg, n_pos and the positive-class weight n_neg / n_pos (NULL when no positives)."""
    agg = df.agg(F.count_if(~F.col(label)).alias("n_neg"), F.count_if(F.col(label)).alias("n_pos"))
    return agg.withColumn("pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")))
