"""Batch scoring: features as of "now" -> probability -> bucket, top factors,
feature snapshot, one shared scored_at; plus the error rows of the batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.constants import BUCKET_A, BUCKET_B, BUCKET_C, MODEL_FEATURES
from propensity.functions import scoring as fs
from propensity.functions.time import as_timestamp
from propensity.operators.features import feature_matrix
from propensity.operators.joins import lookup_by_ids, missing_ids
from propensity.operators.model import probability


@dataclass
class ScoreBatch:
    results: DataFrame   # lead_id, score, bucket, model_version, top_factors, feature_snapshot, scored_at
    errors: DataFrame    # lead_id, position, error


def _finite(cols) -> F.Column:
    ok = F.lit(True)
    for c in cols:
        d = F.col(c).cast("double")
        ok = ok & d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))
    return ok


def score_leads(requested: DataFrame, leads: DataFrame, events: DataFrame, model: PipelineModel,
                model_version: str, importances: list[float], now, feature_names=MODEL_FEATURES,
                thresholds=(BUCKET_A, BUCKET_B, BUCKET_C), salt_buckets: int | None = None) -> ScoreBatch:
    """Score the requested lead ids (``requested``: lead_id [, position]).

    Unknown ids become 'Lead not found' errors; rows whose model inputs are not
    finite become errors instead of being silently dropped; everything else gets a
    prediction row.  ``importances`` are the model's global importances.
    """
    requested = _with_position(requested)
    fm = batch_features(requested, leads, events, now, salt_buckets)
    good = fm.where(_finite(feature_names))
    scored = probability(model.transform(good))
    a, b, c = thresholds
    results = scored.select(
        "lead_id",
        F.col("p").alias("score"),
        fs.score_bucket("p", a, b, c).alias("bucket"),
        F.lit(model_version).alias("model_version"),
        fs.top_factors(list(feature_names), importances).alias("top_factors"),
        fs.feature_snapshot(list(feature_names)).alias("feature_snapshot"),
        as_timestamp(now).alias("scored_at"))
    return ScoreBatch(results=results, errors=batch_errors(requested, leads, fm, feature_names))


def _with_position(requested: DataFrame) -> DataFrame:
    if "position" not in requested.columns:
        requested = requested.withColumn("position", F.monotonically_increasing_id())
    return requested


def batch_features(requested: DataFrame, leads: DataFrame, events: DataFrame, now,
                   salt_buckets: int | None = None) -> DataFrame:
    """Features as of ``now`` for the requested leads that exist: events are semi-joined
    to the request, whatever its size, and nothing is collected."""
    found = lookup_by_ids(leads.select("lead_id"), requested)
    return feature_matrix(found, events, as_of=now, salt_buckets=salt_buckets, restrict_events=True)


def batch_errors(requested: DataFrame, leads: DataFrame, features: DataFrame,
                 feature_names=MODEL_FEATURES) -> DataFrame:
    """(lead_id, position, error): 'Lead not found' for unknown ids (request rows
    kept), 'invalid model input' for leads whose model inputs are not finite."""
    requested = _with_position(requested)
    missing = missing_ids(requested, leads.select("lead_id")).select(
        "lead_id", F.col("position").cast("bigint"), F.lit("Lead not found").alias("error"))
    bad = features.where(~_finite(feature_names)).select(
        "lead_id", F.lit(None).cast("bigint").alias("position"), F.lit("invalid model input").alias("error"))
    return missing.unionByName(bad)


def append_predictions(results: DataFrame, path: str) -> None:
    """Append one prediction row per scored lead, partitioned by model version."""
    (results.withColumn("top_factors", F.to_json("top_factors"))
     .write.mode("append").partitionBy("model_version").parquet(path))


def score_one(lead_id, leads: DataFrame, events: DataFrame, model: PipelineModel, model_version: str,
              importances: list[float], now, **kwargs) -> DataFrame:
    """Score a single lead; an unknown id raises ``LookupError`` ("Lead not found")."""
    spark = leads.sparkSession
    req = spark.createDataFrame([(lead_id, 0)], f"lead_id {leads.schema['lead_id'].dataType.simpleString()}, "
                                                "position bigint")
    batch = score_leads(req, leads, events, model, model_version, importances, now, **kwargs)
    if not batch.errors.isEmpty():
        raise LookupError(f"Lead not found: {lead_id}")
    return batch.results
