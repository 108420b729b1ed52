"""The prediction log as a stored table: partitioned by ``model_version``, bucketed by
``lead_id`` and sorted by (``lead_id``, ``scored_at``) in each bucket.

The layout takes the place of indexes: a filter on the version reads that version's folders
only, and whatever groups or joins by lead finds the rows of a lead in one bucket already, so
the latest prediction per lead needs no shuffle, however long the log gets.  A lead with very
many predictions still makes one bucket longer; the latest row is a running maximum there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.operators.windows import latest_per_key

BUCKETS = 8
COLUMNS = ("lead_id", "score", "bucket", "scored_at", "model_version")


def append(predictions: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Appends to the log, which is created under ``path`` where it isn't there yet.  Rows are dealt
    by the bucketing hash first, so a batch adds one file to each bucket of a version."""
    rows = predictions.select(*COLUMNS).repartition(buckets, "lead_id")
    (rows.write.mode("append").format("parquet").option("path", path).partitionBy("model_version")
     .bucketBy(buckets, "lead_id").sortBy("lead_id", "scored_at").saveAsTable(table))


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


def latest_per_lead(log: DataFrame) -> DataFrame:
    """The latest prediction of each lead (equal times: the highest version)."""
    return latest_per_key(log.select(*COLUMNS), "lead_id", "scored_at", tie="model_version")


def counts(log: DataFrame, version: str | None = None) -> DataFrame:
    """Predictions per version and score bucket; with ``version`` only its partition is read."""
    rows = log if version is None else log.where(F.col("model_version") == version)
    return rows.groupBy("model_version", "bucket").agg(F.count(F.lit(1)).alias("count"))


def history(log: DataFrame, leads: DataFrame) -> DataFrame:
    """All predictions of the given leads.  Spark can't rely on the files' order, but each bucket is
    joined where it lies."""
    return log.select(*COLUMNS).join(leads.select("lead_id"), "lead_id", "left_semi")
