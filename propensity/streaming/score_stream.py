"""Micro-batch scoring: a stream of requested lead ids is scored batch by batch
and the predictions are appended, exactly once per micro-batch."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from propensity.operators.scoring import score_leads


def score_stream(spark: SparkSession, requests_dir: str, leads: DataFrame, events: DataFrame,
                 model: PipelineModel, model_version: str, importances: list[float], now,
                 out_dir: str, checkpoint_dir: str, errors_dir: str | None = None,
                 request_schema: str = "lead_id bigint, position bigint", available_now: bool = True) -> StreamingQuery:
    """Start a query that scores each micro-batch of ``requests_dir`` (Parquet files).

    Each epoch overwrites its own ``epoch=<id>`` directory, so a replayed epoch
    after a failure rewrites the same rows instead of appending duplicates.
    """
    stream = spark.readStream.schema(request_schema).parquet(requests_dir)

    def one_batch(batch: DataFrame, epoch_id: int) -> None:
        scored = score_leads(batch, leads, events, model, model_version, importances, now)
        from pyspark.sql import functions as F
        (scored.results.withColumn("top_factors", F.to_json("top_factors"))
         .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}"))
        if errors_dir:
            scored.errors.write.mode("overwrite").parquet(f"{errors_dir.rstrip('/')}/epoch={epoch_id}")

    writer = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
