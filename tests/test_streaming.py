"""Structured Streaming: throttle state carried across micro-batches; stream scoring."""

import random
import uuid
from datetime import datetime, timedelta

from propensity.streaming.throttle import throttle_stream
from test_windows_metrics import brute_throttle


def test_throttle_stream_across_batches(spark, tmp_path):
    rnd = random.Random(9)
    base = datetime(2024, 1, 1)
    rows = sorted([(rnd.choice(["a", "b"]), rnd.randint(0, 300)) for _ in range(600)], key=lambda r: r[1])
    src = tmp_path / "src"
    # four files in time order -> four micro-batches (one file per trigger)
    for part in range(4):
        chunk = [(k, base + timedelta(seconds=t)) for k, t in rows[part * 150:(part + 1) * 150]]
        spark.createDataFrame(chunk, "k string, t timestamp").coalesce(1).write.parquet(str(src / f"p{part}"))
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(str(src))
    name = "thr_" + uuid.uuid4().hex[:8]
    q = (throttle_stream(stream, "k", "t", max_requests=25, window_seconds=30)
         .writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table(name).collect()
    assert len(got) == 600
    limited = sum(1 for r in got if r["limited"])
    expected = brute_throttle([(k, t, i) for i, (k, t) in enumerate(rows)], 25, 30)
    assert limited == sum(expected.values()) and limited > 0


def test_throttle_stream_forgets_idle_keys(spark, tmp_path):
    base = datetime(2024, 1, 1)
    src = tmp_path / "src"
    for part in range(4):  # a key of its own in every hour
        chunk = [(f"k{part}", base + timedelta(hours=part, seconds=s)) for s in range(5)]
        spark.createDataFrame(chunk, "k string, t timestamp").coalesce(1).write.parquet(str(src / f"p{part}"))
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).parquet(str(src))
    name = "thr_" + uuid.uuid4().hex[:8]
    q = (throttle_stream(stream, "k", "t", max_requests=2, window_seconds=60, max_delay="1 minute")
         .writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table(name).collect()
    assert len(got) == 20 and sum(r["limited"] for r in got) == 12
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 4


def test_append_predictions_and_errors(spark, tmp_path):
    from propensity.operators.scoring import append_predictions
    df = spark.createDataFrame([(1, 0.9, "A", "v1.0")], "lead_id long, score double, bucket string, "
                                                          "model_version string")
    df = df.selectExpr("*", "array(named_struct('feature', 'x', 'impact', 0.5D, 'value', '1')) AS top_factors")
    append_predictions(df, str(tmp_path / "pred"))
    append_predictions(df, str(tmp_path / "pred"))
    back = spark.read.parquet(str(tmp_path / "pred"))
    assert back.count() == 2 and back.where("model_version = 'v1.0'").count() == 2
