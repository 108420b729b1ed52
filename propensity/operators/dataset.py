"""Labelled training set: which leads, their cut-off, features, time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.catalogue import Catalogue, default_catalogue
from propensity.constants import AS_OF_HORIZON_DAYS, FIRMOGRAPHIC_FEATURES, MODEL_FEATURES, TEST_FRACTION
from propensity.functions.time import as_of_date
from propensity.operators.features import feature_matrix
from propensity.operators.joins import with_latest_event
from propensity.operators.windows import global_rank, prefix_sums
from propensity.session import checkpoint


def labelled(leads: DataFrame) -> DataFrame:
    """Known outcome only, and no 'converted' lead without a conversion date."""
    known = F.col("converted").isNotNull()
    undated = F.coalesce(F.col("converted") & F.col("converted_at").isNull(), F.lit(False))
    return leads.where(known & ~undated)


def require_rows(df: DataFrame, message: str = "no lead has a known outcome") -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def with_as_of(leads: DataFrame, events: DataFrame, now, horizon_days: int = AS_OF_HORIZON_DAYS) -> DataFrame:
    """Adds latest_event_at (all events) and the per-lead cut-off ``as_of``."""
    df = with_latest_event(leads, events)
    return df.withColumn("as_of", as_of_date(F.col("converted"), F.col("converted_at"), F.col("created_at"),
                                             F.col("latest_event_at"), now, horizon_days))


def labelled_features(leads: DataFrame, events: DataFrame, now, catalogue: Catalogue = default_catalogue,
                      salt_buckets: int | None = None, materialize: bool = True, test_fraction: float | None = None) -> DataFrame:
    """lead_id, as_of, the 17 model features and ``converted`` for every usable labelled lead,
    with ``test_fraction`` also the ``split`` in time.

    The narrow (lead_id, converted, as_of) table feeds both the point-in-time join
    and the final left join; it is checkpointed once (shared checkpoint folder) so
    the event aggregation behind ``as_of`` runs a single time.  The split is decided on
    it and carried along, so feature rows are neither sorted nor written for it.
    """
    lab = with_as_of(labelled(leads.select("lead_id", "converted", "converted_at", "created_at")), events, now)
    lab = lab.select("lead_id", "converted", "as_of")
    if materialize:
        lab = checkpoint(lab)
    carry = ("converted",)
    if test_fraction is not None:
        lab, carry = time_split(lab, test_fraction=test_fraction), ("converted", "split")
    # No scan bound: a converted lead's cut-off (conversion - 1 day) may lie after ``now``.
    fm = feature_matrix(lab, events, as_of_col="as_of", catalogue=catalogue, salt_buckets=salt_buckets,
                        carry=carry)
    keep = [c for c in fm.columns if c not in FIRMOGRAPHIC_FEATURES]
    return fm.select(*keep)


def _plain(col: str, kind: T.DataType) -> Column:
    """A column in a form that reaches the driver and comes back as a literal unchanged, whatever the
    time zones of session and driver: local times as text, instants as microseconds."""
    if isinstance(kind, T.TimestampNTZType):
        return F.col(col).cast("string")
    return F.unix_micros(col) if isinstance(kind, T.TimestampType) else F.col(col)


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(value).cast(kind)


def _day(col: str, kind: T.DataType) -> Column | None:
    """The number of a time's day, in the order of the times themselves: of an instant in UTC, whatever
    clock changes the session's zone has.  None for other types."""
    if isinstance(kind, T.TimestampType):
        return F.floor(F.unix_micros(col) / F.lit(86_400_000_000)).cast("long")
    return F.unix_date(F.col(col).cast("date")) if isinstance(kind, (T.TimestampNTZType, T.DateType)) else None


def time_split(df: DataFrame, ts: str = "as_of", key: str = "lead_id", test_fraction: float = TEST_FRACTION,
               partitions: int | None = None) -> DataFrame:
    """Adds ``split``: the first floor(n * (1 - test_fraction)) rows in (ts, key)
    order are 'train', the rest 'test' (ties in ts broken by key, which must be unique among them;
    a null comes first, as in a sort).

    The cut is selected by counting: rows per day (partial aggregates; there are at most as many
    days as the calendar has), summed up to the day where the cut falls, and, among the rows of that one
    day only, the (ts, key) of the last training row.  Where ``ts`` is no time its values are counted
    instead, with distributed prefix sums.  Only counts and the (ts, key) of one day are ordered; one
    position reaches the driver and the split is a comparison on each row."""
    kind, key_kind = df.schema[ts].dataType, df.schema[key].dataType
    span = _day(ts, kind)
    counts = df.groupBy((F.col(ts) if span is None else span).alias("span")).agg(F.count(F.lit(1)).alias("n"))
    if span is None:
        span = F.col(ts)
        sums = prefix_sums(counts, ["span"], ["n"], partitions)
        sums = sums.withColumn("total", sums.agg(F.sum("n").alias("total")).scalar())
    else:
        before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before_n"),
                             F.sum("n").over(Window.partitionBy()).alias("total"))
    found = sums.withColumn("cut", F.floor(F.col("total") * F.lit(1.0 - test_fraction)))
    at = found.where((F.col("_before_n") < F.col("cut")) & (F.col("_before_n") + F.col("n") >= F.col("cut"))).first()
    if at is None or at["cut"] >= at["total"]:  # no training rows, or only such
        return df.withColumn("split", F.lit("test" if at is None else "train"))
    rest, t = at["cut"] - at["_before_n"], F.col(ts)
    if rest == at["n"]:
        train = F.coalesce(span <= F.lit(at["span"]), t.isNull())
    else:
        ranked = global_rank(df.where(span.eqNullSafe(F.lit(at["span"]))).select(ts, key), [ts, key], partitions=partitions)
        last = ranked.where(F.col("_rank") == rest).select(_plain(ts, kind).alias("t"), _plain(key, key_kind).alias("k")).first()
        here = _literal(last["t"], kind)
        earlier = F.coalesce(t < here, t.isNull() & F.lit(last["t"] is not None))
        train = earlier | (t.eqNullSafe(here) & F.coalesce(F.col(key) <= _literal(last["k"], key_kind), F.col(key).isNull()))
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def training_dataset(leads: DataFrame, events: DataFrame, now, test_fraction: float = TEST_FRACTION,
                     salt_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the 17 model features + converted, split on time."""
    lab = require_rows(labelled(leads))
    split = labelled_features(lab, events, now, salt_buckets=salt_buckets, test_fraction=test_fraction)
    cols = list(MODEL_FEATURES) + ["converted"]
    train = split.where(F.col("split") == "train").select(*cols)
    test = split.where(F.col("split") == "test").select(*cols)
    return train, test


def label_rate(df: DataFrame, label: str = "converted", by: str | None = None) -> DataFrame:
    """Share of positive labels: one row, or one for each value of ``by`` (the split)."""
    return df.groupBy(*[by] if by else []).agg(F.avg(F.col(label).cast("double")).alias("label_rate"))
