"""Join operators between leads, events and requests (all keyed on lead_id)."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.session import checkpoint, scratch_path
from propensity.sources import files


def latest_event(events: DataFrame, key: str = "lead_id", ts: str = "occurred_at") -> DataFrame:
    """max(ts) per key (partial aggregation before the shuffle)."""
    return events.groupBy(key).agg(F.max(ts).alias("latest_event_at"))


def with_latest_event(leads: DataFrame, events: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads LEFT JOIN their latest event time; aggregate first, then join 1:1."""
    return leads.join(latest_event(events, key), key, "left")


def without_events(leads: DataFrame, events: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads that own no event (anti join, no DISTINCT needed)."""
    return leads.join(events.select(key), key, "left_anti")


def lookup_by_ids(leads: DataFrame, ids: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads whose key is requested; absent ids are silently missing (semi join)."""
    return leads.join(ids.select(key), key, "left_semi")


def missing_ids(requested: DataFrame, leads: DataFrame, key: str = "lead_id") -> DataFrame:
    """Requested ids that are not leads; request rows (position, duplicates) are kept."""
    return requested.join(leads.select(key), key, "left_anti")


def nest_children(parent: DataFrame, child: DataFrame, key: str = "lead_id", prefix: str = "") -> DataFrame:
    """Relationship traversal parent -> children as a flat equi-join (one row per
    child, parents without children dropped).  Children are not collected into one
    array per parent: a parent may own an unbounded number of children."""
    c = child
    if prefix:
        c = c.select(key, *[F.col(x).alias(prefix + x) for x in child.columns if x != key])
    return parent.join(c, key, "inner")


def delete_cascade(leads_to_delete: DataFrame, events: DataFrame, key: str = "lead_id") -> DataFrame:
    """Events that remain after deleting the given leads (ON DELETE CASCADE)."""
    return events.join(leads_to_delete.select(key), key, "left_anti")


def delete_restricted(leads_to_delete: DataFrame, *referencing: DataFrame, key: str = "lead_id") -> DataFrame:
    """Leads whose deletion is refused because a referencing row exists (ON DELETE RESTRICT)."""
    blocked = None
    for ref in referencing:
        part = leads_to_delete.join(ref.select(key), key, "left_semi")
        blocked = part if blocked is None else blocked.unionByName(part)
    if blocked is None:
        return leads_to_delete.limit(0)
    return blocked.dropDuplicates([key])


def update_by_key(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keyed update: columns from ``updates`` replace the table's values where the
    key matches (one update row per key), other rows unchanged."""
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    joined = table.join(u, key, "left")
    out = []
    for c in table.columns:
        if c in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def update_partitions(spark: SparkSession, path: str, updates: DataFrame, key: str, columns: list[str],
                      partition_by: tuple[str, ...]) -> list[tuple]:
    """``update_by_key`` on a partitioned Parquet table, copy on write: only the partitions that
    hold an updated key are rewritten; files of the others aren't read beyond the key column,
    nor touched.  Returns the rewritten partitions.

    The new rows are staged in the shared folder first and then swapped in, partition by
    partition, by a dynamic overwrite.  A writer that dies before the swap has changed nothing; one
    that dies within it leaves each partition either old or new, and the same call again finishes
    the update.  ``updates`` has one row per key; a partition column can't be updated."""
    if moved := set(columns) & set(partition_by):
        raise ValueError(f"rows can't move between partitions: {sorted(moved)}")
    if tuple(partition_by) != files.partition_columns(spark, path):
        raise ValueError(f"the table is partitioned by {files.partition_columns(spark, path)}")
    table = spark.read.parquet(path)
    updates = checkpoint(updates.select(key, *columns))  # read twice: the same rows both times
    touched = table.join(updates.select(key), key, "left_semi").select(*partition_by).distinct().collect()
    if not touched:
        return []
    if len(partition_by) == 1:
        values = [r[0] for r in touched]
        mine = F.col(partition_by[0]).isin([v for v in values if v is not None])
        mine = mine | F.col(partition_by[0]).isNull() if None in values else mine
    else:
        mine = reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by]) for r in touched])
    rows = update_by_key(table.where(mine), updates, key, columns)
    staged = scratch_path(spark, f"update-{uuid.uuid4().hex}")
    rows.write.partitionBy(*partition_by).parquet(staged)
    (spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))
    return sorted(tuple(r) for r in touched)
