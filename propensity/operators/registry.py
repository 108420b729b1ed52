"""Versioned model registry kept as a small table (version, artifact_path, metrics,
hyperparameters, feature_columns, is_active, trained_at).

Every change produces a new registry DataFrame.  :class:`RegistryStore` keeps them: each
commit writes a folder of its own, which is never changed again, and then creates the
numbered file that names it, only if no other writer has created that number.  So readers see
whole tables only, of two writers one wins and the other starts again from the winner's
table, and a version that is there already is refused inside that step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.sources import files

REGISTRY_SCHEMA = ("version string, artifact_path string, metrics map<string,double>, "
                   "hyperparameters string, feature_columns array<string>, is_active boolean, "
                   "trained_at timestamp")


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def parsed_versions(registry: DataFrame, col: str = "version") -> DataFrame:
    """(major, minor) of every well-formed ``v<major>.<minor>`` (other part counts ignored)."""
    parts = F.split(F.regexp_replace(F.col(col), r"^v+", ""), r"\.")
    return (registry.select(parts.alias("_p")).where(F.size("_p") == 2)
            .select(F.col("_p")[0].cast("int").alias("major"), F.col("_p")[1].cast("int").alias("minor")))


def next_version(registry: DataFrame, col: str = "version") -> DataFrame:
    """One row ``next_version``: highest (major, minor) compared numerically, minor + 1;
    ``v1.0`` for an empty registry; the starting point is (1, -1)."""
    best = parsed_versions(registry, col).agg(F.max(F.struct("major", "minor")).alias("b"))
    floor_ = F.struct(F.lit(1).alias("major"), F.lit(-1).alias("minor"))
    top = F.greatest(F.coalesce(F.col("b"), floor_), floor_)
    return best.select(F.concat(F.lit("v"), top["major"].cast("string"), F.lit("."),
                                (top["minor"] + 1).cast("string")).alias("next_version"))


def register_model(registry: DataFrame, version: str, artifact_path: str, metrics: dict,
                   hyperparameters: dict, feature_columns: list[str], set_active: bool = False,
                   trained_at: datetime | None = None) -> DataFrame:
    """Registry with one more row; with ``set_active`` every other row is deactivated first."""
    spark = registry.sparkSession
    ts = trained_at or datetime.now(timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame(
        [(version, str(artifact_path), {k: float(v) for k, v in metrics.items() if v is not None},
          json.dumps(hyperparameters, sort_keys=True, default=str), list(feature_columns), bool(set_active), ts)],
        REGISTRY_SCHEMA)
    base = registry
    if set_active:
        base = registry.withColumn("is_active", F.lit(False))
    return base.unionByName(row)


def active(registry: DataFrame) -> DataFrame:
    return registry.where(F.coalesce(F.col("is_active"), F.lit(False)))


def active_model_info(registry: DataFrame) -> DataFrame:
    """version, metrics ({} when missing), feature_columns ([] when missing),
    trained_at, is_active of the active row(s); callers check there is exactly one."""
    return active(registry).select(
        "version",
        F.coalesce(F.col("metrics"), F.create_map().cast("map<string,double>")).alias("metrics"),
        F.coalesce(F.col("feature_columns"), F.array().cast("array<string>")).alias("feature_columns"),
        "trained_at", "is_active")


def require_single_active(registry: DataFrame):
    rows = active(registry).limit(2).collect()
    if not rows:
        raise LookupError("no version is active")
    if len(rows) > 1:
        raise LookupError("several versions are active")
    return rows[0]


class DuplicateVersion(ValueError):
    """The registry has a row of that version."""


class CommitConflict(RuntimeError):
    """Other writers were faster at every attempt."""


class RegistryStore:
    """A registry table under ``path`` on any Hadoop file system, changed by commits.

    ``tables/<name>``: the table of one commit, never changed.  ``commits/<number>``: a one-line
    file with that name.  Tables that lost a race or whose writer died have no commit file and
    are never read (``unreferenced`` lists them).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commits(self) -> list[int]:
        return [int(n) for n in files.names(self.spark, f"{self.path}/commits") if n.isdigit()]

    def read(self, number: int | None = None) -> DataFrame:
        """The registry as of a commit, the last one by default; empty before the first."""
        if number is None:
            number = max(self.commits(), default=0)
        if number == 0:
            return empty_registry(self.spark)
        name = files.read_text(self.spark, f"{self.path}/commits/{number:012d}")
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.path}/tables/{name}")

    def commit(self, change: Callable[[DataFrame], DataFrame], attempts: int = 10) -> int:
        """Publishes ``change(current table)`` and returns the number of the commit.

        Raises ``DuplicateVersion`` where the new table has a version twice.  ``change`` is
        called again, with the newer table, where another writer was faster."""
        for _ in range(attempts):
            last = max(self.commits(), default=0)
            table = change(self.read(last))
            twice = table.groupBy("version").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and version is not null").first()
            if twice:
                raise DuplicateVersion(f"version {twice['version']} is registered already")
            name = uuid.uuid4().hex
            table.select(*[f.split()[0] for f in REGISTRY_SCHEMA.split(", ")]).write.parquet(f"{self.path}/tables/{name}")
            if files.create_if_absent(self.spark, f"{self.path}/commits/{last + 1:012d}", name):
                return last + 1
        raise CommitConflict(f"{attempts} attempts to change {self.path} were overtaken")

    def register(self, version: str, artifact_path: str, metrics: dict, hyperparameters: dict, feature_columns: list[str],
                 set_active: bool = False, trained_at: datetime | None = None) -> int:
        """``register_model`` as a commit."""
        return self.commit(lambda now: register_model(now, version, artifact_path, metrics, hyperparameters, feature_columns,
                                                      set_active, trained_at))

    def unreferenced(self) -> list[str]:
        used = {files.read_text(self.spark, f"{self.path}/commits/{n:012d}") for n in self.commits()}
        return [n for n in files.names(self.spark, f"{self.path}/tables") if n not in used]
