"""Table constraints (NOT NULL, max length, enum CHECK, UNIQUE, FK) reported per
row as an array of violated rule names instead of aborting the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity.constants import (EVENT_TYPES, EVENT_VARCHAR_LIMITS, LEAD_VARCHAR_LIMITS, PREDICTION_BUCKETS,
                                  PREDICTION_VARCHAR_LIMITS, REGISTRY_VARCHAR_LIMITS, SYNC_STATUSES,
                                  SYNC_VARCHAR_LIMITS)


def _rule(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))


def not_null(*cols: str) -> list[Column]:
    return [_rule(f"not_null:{c}", F.col(c).isNull()) for c in cols]


def max_length(limits) -> list[Column]:
    return [_rule(f"max_length:{c}", F.length(c) > n) for c, n in limits]


def one_of(col: str, values) -> Column:
    return _rule(f"check:{col}", ~F.col(col).isin(*values))


def violations(df: DataFrame, rules: list[Column], unique: list[str] = (), fk: list[tuple] = ()) -> DataFrame:
    """Adds ``violations`` (array<string>, empty when the row is fine).

    ``unique``: key columns that must not repeat (counted by an aggregate joined
    back on the key).  ``fk``: (column, parent DataFrame, parent key) references.
    """
    out = df
    extra = []
    for key in unique:
        dup = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"_n_{key}"))
               .where(F.col(f"_n_{key}") > 1))
        out = out.join(dup, key, "left")
        extra.append(_rule(f"unique:{key}", F.col(f"_n_{key}").isNotNull()))
    for col, parent, pkey in fk:
        ref = parent.select(F.col(pkey).alias(f"_fk_{col}")).distinct().withColumn(f"_hit_{col}", F.lit(True))
        out = out.join(ref, out[col] == ref[f"_fk_{col}"], "left")
        extra.append(_rule(f"fk:{col}", F.col(col).isNotNull() & F.col(f"_hit_{col}").isNull()))
    arr = F.array_compact(F.array(*(rules + extra)))
    helper = [c for c in out.columns if c.startswith("_n_") or c.startswith("_fk_") or c.startswith("_hit_")]
    return out.withColumn("violations", arr).drop(*helper)


def _present(df: DataFrame, cols) -> list:
    have = set(df.columns)
    return [c for c in cols if (c[0] if isinstance(c, tuple) else c) in have]


def lead_violations(leads: DataFrame) -> DataFrame:
    """Rules of the leads table, for the columns the frame has."""
    rules = not_null(*_present(leads, ["external_id", "source_system"]))
    rules += max_length(_present(leads, LEAD_VARCHAR_LIMITS))
    return violations(leads, rules, unique=["external_id"])


def event_violations(events: DataFrame, leads: DataFrame) -> DataFrame:
    rules = not_null(*_present(events, ["lead_id", "event_type", "occurred_at"]))
    rules += max_length(_present(events, EVENT_VARCHAR_LIMITS))
    rules.append(one_of("event_type", EVENT_TYPES))
    return violations(events, rules, fk=[("lead_id", leads, "lead_id")])


def prediction_violations(predictions: DataFrame, leads: DataFrame) -> DataFrame:
    rules = not_null(*_present(predictions, ["lead_id", "score", "bucket", "model_version", "scored_at"]))
    rules += max_length(_present(predictions, PREDICTION_VARCHAR_LIMITS))
    rules.append(one_of("bucket", PREDICTION_BUCKETS))
    return violations(predictions, rules, fk=[("lead_id", leads, "lead_id")])


def sync_log_violations(logs: DataFrame, leads: DataFrame) -> DataFrame:
    rules = not_null(*_present(logs, ["lead_id", "source_system", "action", "status"]))
    rules += max_length(_present(logs, SYNC_VARCHAR_LIMITS))
    rules.append(one_of("status", SYNC_STATUSES))
    return violations(logs, rules, fk=[("lead_id", leads, "lead_id")])


def registry_violations(registry: DataFrame) -> DataFrame:
    rules = not_null(*_present(registry, ["version", "artifact_path", "trained_at"]))
    rules += max_length(_present(registry, REGISTRY_VARCHAR_LIMITS))
    return violations(registry, rules, unique=["version"])


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Server-side defaults: a NULL in a defaulted column takes the default."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                       for c in df.columns])


LEAD_DEFAULTS = {"do_not_email": False, "do_not_call": False}
SYNC_DEFAULTS = {"status": "pending"}
REGISTRY_DEFAULTS = {"is_active": False}
