"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

_SCOPE: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


# Session settings this workload wants; each is applied only where the deployment
# (spark-submit --conf, spark-defaults) has not set it already.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "propensity", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session tuned for this workload.

    On a cluster the master, memory and shuffle sizing come from spark-submit and
    are left alone; only unset settings are filled in.  AQE stays on so shuffle
    partitions coalesce at runtime, skewed join partitions split, and small join
    sides become broadcasts only after their real shuffle size is measured.  A
    local master (tests, the bench) gets a small shuffle-partition count.
    Explicit ``shuffle_partitions`` / ``extra`` always apply.
    """
    launched = bool(os.environ.get("PYSPARK_GATEWAY_PORT"))  # JVM already started by spark-submit
    master = master or os.environ.get("SPARK_MASTER")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    elif not launched:
        builder = builder.master(f"local[{os.environ.get('BENCH_CPUS', '*')}]")
    # launch-time settings: only effective when this process starts the JVM
    if not launched:
        builder = (builder.config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    deployed = spark.sparkContext.getConf()
    for k, v in RUNTIME_DEFAULTS.items():
        if not deployed.contains(k):
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif (spark.sparkContext.master or "").startswith("local") and not deployed.contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k, v in (extra or {}).items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (an error where it is unset); only
    a local master (one machine, as in tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master or ""):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="propensity-ckpt-")
    sc.setCheckpointDir(configured)  # the context keeps it: the setting itself can't be changed in a session
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder, or the open scope's folder in it, for
    written intermediate tables."""
    base = (_SCOPE.get() or checkpoint_dir(spark)).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "run") -> Iterator[str]:
    """A folder for the intermediate tables that operators write inside the scope, deleted at
    its end, after an error too.

    Results are lazy and read these tables: write or collect them inside.  Scopes may be nested, an
    inner one ends on its own; each thread has its own.  Without a scope the tables stay, and so do
    Spark's checkpoints unless the deployment sets ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    from propensity.sources import files
    folder = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    outer = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(outer)
        files.remove(spark, folder)


def checkpoint(df, eager: bool = True):
    """``df.checkpoint`` into the shared folder (resolved first, so a session that
    was built elsewhere works too).  Reliable: survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
