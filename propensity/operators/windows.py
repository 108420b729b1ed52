"""Ordered operators: first/latest row per key, global rank, sessionisation.

None of them routes a whole key through one task: first/latest use decomposable
``min_by``/``max_by`` aggregates, the global rank uses range partitioning plus a
per-partition offset table, and sessionisation works per (key, time bucket) with
small per-bucket summaries stitched together by prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propensity.session import checkpoint


def _first_by(df: DataFrame, key: str | list[str], order: list, pick) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    order_val = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    row = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(pick(row, order_val).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]))


def dedup_first(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """First row per key by ``order`` (input order for idempotent loads).

    ``min_by`` is partially aggregated before the shuffle, so a key owning many
    rows never gathers in one task.
    """
    return _first_by(df, key, order, F.min_by)


def latest_per_key(df: DataFrame, key: str | list[str], ts: str, tie: str | None = None) -> DataFrame:
    """Latest row per key by ``ts`` (ties: highest ``tie``)."""
    order = [ts] + ([tie] if tie else [])
    return _first_by(df, key, order, F.max_by)


def global_rank(df: DataFrame, order: list[str], partitions: int | None = None, name: str = "_rank",
                materialize: bool = True) -> DataFrame:
    """1-based rank of every row in ``order`` (which must be a total order) without
    a single-partition sort: range partitioning, a rank inside each partition, then
    an offset per partition from the partition sizes (one row per partition, so
    broadcasting it is bounded by the partition count).  The ranked frame is
    checkpointed to the shared checkpoint folder so both uses read one copy.
    Adds ``name`` and ``_total`` (row count).
    """
    spark = df.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    local = (ranged.withColumn("_pid", F.spark_partition_id())
             .withColumn("_lrank", F.monotonically_increasing_id()
                         - F.shiftleft(F.spark_partition_id().cast("bigint"), 33) + F.lit(1)))
    if materialize:
        local = checkpoint(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(everything).alias("_total"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_lrank"))
            .drop("_pid", "_lrank", "_off"))


def _epoch_micros(df: DataFrame, ts: str):
    """Microseconds since the epoch (wall clock for ``timestamp_ntz``)."""
    from pyspark.sql import types as T
    t = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    return F.unix_micros(t.cast("timestamp"))


def sessionize(events: DataFrame, key: str = "lead_id", ts: str = "occurred_at", type_col: str = "event_type",
               page_type: str = "page_view", gap_seconds: int = 1800, tie: str = "event_id",
               bucket_seconds: int = 86_400, rows_per_task: int | None = None) -> DataFrame:
    """Session number for page views: per key in time order, a page view continues
    the current session iff the immediately preceding event (of any type) is a page
    view at most ``gap_seconds`` earlier; any other event breaks the chain.

    Adds ``session_no`` (1, 2, ... per key; NULL for other event types).  Work runs
    per (key, time bucket); the previous bucket's last event and the number of
    sessions started before a bucket come from per-bucket summaries (bounded by
    the number of non-empty buckets, not by event volume).  Buckets are
    ``bucket_seconds`` wide; a key owning more than ``rows_per_task`` rows gets
    proportionally narrower buckets (from the bounded hot-key table), so a key with
    a third of all events is still spread over many tasks.
    """
    from propensity.operators.features import ROWS_PER_TASK, hot_keys
    width = int(bucket_seconds) * 1_000_000
    hot = hot_keys(events.select(key), key, rows_per_task or ROWS_PER_TASK).withColumnRenamed("_pit_k", "_sk")
    ev = events.join(hot, key, "left")
    w_us = F.greatest(F.lit(1), F.floor(F.lit(width) / F.coalesce(F.col("_sk"), F.lit(1))))
    bucketed = ev.withColumn("_bucket", F.floor(_epoch_micros(events, ts) / w_us).cast("bigint")).drop("_sk")
    t, is_pv = F.col(ts), F.col(type_col) == page_type
    w_in = Window.partitionBy(key, "_bucket").orderBy(ts, tie)
    event = F.struct(F.col(type_col).alias("t"), t.alias("ts"))

    def goes_on(before, now):
        """Whether a page view continues the session of the event before it."""
        return F.coalesce((before["t"] == page_type) & (F.timestamp_diff("MICROSECOND", before["ts"], now["ts"]) <= gap_seconds * 1_000_000),
                          F.lit(False))

    # sessions that start inside a bucket; its first event depends on the bucket before
    ev = bucketed.withColumn("_before", F.lag(event).over(w_in))
    ev = ev.withColumn("_start", (is_pv & F.col("_before").isNotNull() & ~goes_on(F.col("_before"), event)).cast("int"))
    ev = ev.withColumn("_local", F.sum("_start").over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per bucket: its starts, first and last event; all that is left is done on these
    order = F.struct(t, F.col(tie))
    buckets = ev.groupBy(key, "_bucket").agg(F.sum("_start").alias("_s"), F.min_by(event, order).alias("_first"),
                                             F.max_by(event, order).alias("_last"))
    w_b = Window.partitionBy(key).orderBy("_bucket")
    buckets = buckets.withColumn("_prev", F.lag("_last").over(w_b))
    opens = (F.coalesce(F.col("_first.t") == page_type, F.lit(False)) & ~goes_on(F.col("_prev"), F.col("_first"))).cast("int")
    buckets = buckets.withColumn("_s", F.col("_s") + opens).withColumn("_opens", opens)
    before = F.coalesce(F.sum("_s").over(w_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(key, "_bucket", (before + F.col("_opens")).alias("_base"))
    out = ev.join(buckets, [key, "_bucket"], "left")
    out = out.withColumn("session_no", F.when(is_pv, (F.col("_base") + F.col("_local")).cast("bigint")))
    return out.drop("_bucket", "_before", "_start", "_local", "_base")


def prefix_sums(df: DataFrame, order: list, cols: list[str], partitions: int | None = None) -> DataFrame:
    """Adds ``_before_<c>`` = sum of ``c`` over all rows strictly before each row in
    ``order`` (a total order; names or sort columns).

    Range partitioning keeps neighbours together; each partition computes local
    prefixes and a per-partition total table (one row per partition) supplies the
    offsets, so no single task sees all rows.  The ranged frame is checkpointed
    once and both parts read that copy: two range exchanges would draw their own
    samples and number their partitions differently.  ``partitions`` fixes the
    number of ranges; without it the optimizer chooses."""
    ranges = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
    ranged = checkpoint(ranged_ids(ranges))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_lp_{c}") for c in cols])
    totals = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_o_{c}")
                                      for c in cols])
    out = local.join(F.broadcast(offsets), "_pid")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_lp_{c}")).alias(f"_before_{c}") for c in cols])


def ranged_ids(ranged: DataFrame) -> DataFrame:
    """``_pid``: the number of the range a row lies in (ranges are numbered in order)."""
    return ranged.withColumn("_pid", F.spark_partition_id())
