"""Stored tables: registry commits, copy-on-write updates, the prediction log's layout, CSV rejects."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from propensity.operators import joins as jn
from propensity.operators import registry as rg
from propensity.sources import files
from propensity.sources import prediction_log as pl
from propensity.sources import tables as tb


def model(store, version, **kw):
    return store.register(version, f"models/{version}", {"auc_roc": 0.5, "f1": None}, {"max_depth": 6}, ["a", "b"], **kw)


# --- M11 registry commits

def test_registry_commits_and_history(spark, tmp_path):
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    assert store.commits() == [] and store.read().isEmpty()
    assert model(store, "v1.0", set_active=True) == 1 and model(store, "v1.1", set_active=True) == 2
    assert {r["version"]: r["is_active"] for r in store.read().collect()} == {"v1.0": False, "v1.1": True}
    assert [r["version"] for r in store.read(1).collect()] == ["v1.0"]
    assert rg.require_single_active(store.read())["version"] == "v1.1"
    row = store.read().where("version = 'v1.0'").first()
    assert row["metrics"] == {"auc_roc": 0.5} and row["feature_columns"] == ["a", "b"] and row["trained_at"] is not None


def test_repeated_version_is_refused(spark, tmp_path):
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    model(store, "v1.0")
    with pytest.raises(rg.DuplicateVersion):
        model(store, "v1.0", set_active=True)
    assert store.commits() == [1] and store.read().count() == 1 and not store.read().first()["is_active"]
    with pytest.raises(rg.DuplicateVersion):
        store.commit(lambda now: now.unionByName(now))


def test_racing_writers_lose_no_row(spark, tmp_path):
    """All start from the same table; each number is created once, the losers start again."""
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    model(store, "v0.0")
    gate, calls, numbers = threading.Barrier(4), [], {}

    def write(k):
        met = []

        def change(now):
            calls.append(k)
            if not met:
                met.append(gate.wait())
            return rg.register_model(now, f"v1.{k}", "p", {}, {}, [])
        numbers[k] = store.commit(change)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(numbers.values()) == [2, 3, 4, 5] and len(calls) > 4
    assert {r["version"] for r in store.read().collect()} == {"v0.0", "v1.0", "v1.1", "v1.2", "v1.3"}
    assert len(store.unreferenced()) == len(calls) - 4  # one table for each lost race


def test_two_writers_of_one_version_leave_one(spark, tmp_path):
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    gate, refused = threading.Barrier(2), []

    def write(path):
        met = []

        def change(now):
            if not met:
                met.append(gate.wait())
            return rg.register_model(now, "v1.0", path, {}, {}, [])
        try:
            store.commit(change)
        except rg.DuplicateVersion:
            refused.append(path)

    threads = [threading.Thread(target=write, args=(p,)) for p in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(refused) == 1 and [r["artifact_path"] for r in store.read().collect()] == list({"a", "b"} - set(refused))


def test_half_written_tables_are_not_seen(spark, tmp_path):
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    model(store, "v1.0")
    before = store.read().collect()
    rg.register_model(store.read(), "v1.1", "p", {}, {}, []).write.parquet(f"{tmp_path}/reg/tables/unfinished")  # its writer died here
    assert store.read().collect() == before and store.unreferenced() == ["unfinished"]
    with pytest.raises(ZeroDivisionError):
        store.commit(lambda now: 1 / 0)
    assert store.commits() == [1]


def test_conflicts_end(spark, tmp_path, monkeypatch):
    store = rg.RegistryStore(spark, f"{tmp_path}/reg")
    monkeypatch.setattr(files, "create_if_absent", lambda *a: False)
    with pytest.raises(rg.CommitConflict):
        store.commit(lambda now: now, attempts=2)


def test_create_if_absent(spark, tmp_path):
    path = f"{tmp_path}/new/folder/x"
    assert files.create_if_absent(spark, path, "first") and not files.create_if_absent(spark, path, "second")
    assert files.read_text(spark, path) == "first" and files.names(spark, f"{tmp_path}/new/folder") == ["x"]
    assert files.names(spark, f"{tmp_path}/none") == []


# --- S7 copy on write

def leads_table(spark, path, n=200):
    df = spark.range(n).select(F.col("id").alias("lead_id"), F.lit("a").alias("status"), F.lit(None).cast("timestamp_ntz").alias("at"),
                               (F.col("id") % 10).cast("int").alias("part"))
    df.repartition("part").write.partitionBy("part").parquet(path)


def test_update_rewrites_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/leads"
    leads_table(spark, path)
    before = files.modified(spark, path)
    ups = spark.createDataFrame([(3, "x"), (13, "y"), (27, None), (9999, "z")], "lead_id long, status string")
    assert jn.update_partitions(spark, path, ups, "lead_id", ["status"], ("part",)) == [(3,), (7,)]
    after = files.modified(spark, path)
    kept = {k: v for k, v in before.items() if not k.startswith(("part=3/", "part=7/"))}
    assert len(kept) == 8 and {k: v for k, v in after.items() if k in kept} == kept
    assert not {k for k in before if k.startswith(("part=3/", "part=7/"))} & set(after)
    got = {r["lead_id"]: r["status"] for r in spark.read.parquet(path).collect()}
    assert got == {i: {3: "x", 13: "y", 27: None}.get(i, "a") for i in range(200)}
    assert jn.update_partitions(spark, path, ups, "lead_id", ["status"], ("part",)) == [(3,), (7,)]  # again: the same rows
    assert {r["lead_id"]: r["status"] for r in spark.read.parquet(path).collect()} == got


def test_update_without_a_match_writes_nothing(spark, tmp_path):
    path = f"{tmp_path}/leads"
    leads_table(spark, path, 20)
    before = files.modified(spark, path)
    ups = spark.createDataFrame([(-1, "x"), (None, "y")], "lead_id long, status string")
    assert jn.update_partitions(spark, path, ups, "lead_id", ["status"], ("part",)) == []
    assert files.modified(spark, path) == before
    with pytest.raises(ValueError):
        jn.update_partitions(spark, path, ups, "lead_id", ["part"], ("part",))


def test_update_of_nested_and_null_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = [(i, "a", ["x", None][i % 2], i % 3) for i in range(24)]
    spark.createDataFrame(rows, "k long, v string, p string, q int").write.partitionBy("p", "q").parquet(path)
    ups = spark.createDataFrame([(1, "new"), (2, "new")], "k long, v string")
    before = files.modified(spark, path)
    assert jn.update_partitions(spark, path, ups.where("k = 1"), "k", ["v"], ("p", "q")) == [(None, 1)]
    assert jn.update_partitions(spark, path, ups.where("k = 2"), "k", ["v"], ("p", "q")) == [("x", 2)]
    assert {r["k"] for r in spark.read.parquet(path).where("v = 'new'").collect()} == {1, 2}
    assert spark.read.parquet(path).count() == 24 and len(set(before) & set(files.modified(spark, path))) == len(before) * 4 // 6
    with pytest.raises(ValueError):
        jn.update_partitions(spark, path, ups, "k", ["v"], ("p",))  # not how the table lies


# --- K5, W6 prediction log

@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log")
    rows = [(i % 40, (i % 10) / 10, "ABCD"[i % 4], f"v1.{i % 3}", f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(400)]
    df = spark.createDataFrame(rows, "lead_id long, score double, bucket string, model_version string, t string").select(
        "*", F.col("t").cast("timestamp_ntz").alias("scored_at"))
    name = f"log_{path.name.replace('-', '_')}"
    pl.append(df.limit(150), name, str(path))
    pl.append(df.exceptAll(df.limit(150)), name, str(path))
    return df, pl.read(spark, name)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_log_holds_every_row(log):
    df, stored = log
    assert sorted(map(tuple, stored.select(pl.COLUMNS[0], "scored_at", "model_version").collect())) == sorted(
        map(tuple, df.select(pl.COLUMNS[0], "scored_at", "model_version").collect()))


def test_latest_needs_no_shuffle(log):
    df, stored = log
    latest = pl.latest_per_lead(stored)
    want = {}
    for r in df.collect():
        want[r["lead_id"]] = max(want.get(r["lead_id"], (r["scored_at"], "")), (r["scored_at"], r["model_version"]))
    assert {r["lead_id"]: (r["scored_at"], r["model_version"]) for r in latest.collect()} == want
    assert "Exchange" not in plan(latest) and "Bucketed: true" in latest._jdf.queryExecution().explainString(
        latest.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_version_reads_its_partition(log):
    df, stored = log
    one = pl.counts(stored, "v1.1")
    assert {r["bucket"]: r["count"] for r in one.collect()} == {
        r["bucket"]: r["count"] for r in df.where("model_version = 'v1.1'").groupBy("bucket").count().collect()}
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan(one)).group(1)
    assert "model_version" in filters and "v1.1" in filters
    assert one.select("model_version").distinct().count() == 1 and pl.counts(stored).count() == 12


def test_history_of_leads(log, spark):
    df, stored = log
    some = spark.createDataFrame([(3,), (5,), (5,), (None,), (999,)], "lead_id long")
    assert pl.history(stored, some).count() == df.where("lead_id in (3, 5)").count()


# --- S1 rejects

def test_rows_with_too_many_or_too_few_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n6\n"7,""x""", 8 \n\n,NA\n')
    (tmp_path / "b.csv").write_text("a,b\n9,10\n")
    rows, rejected = tb.scan_leads_csv(spark, str(tmp_path))
    assert sorted((r["a"] or "", r["b"] or "") for r in rows.collect()) == [("", ""), ("1", "2"), ('7,"x"', " 8 "), ("9", "10")]
    assert sorted(r["line"] for r in rejected.collect()) == ["3,4,5", "6"]
    assert rows.select("a").count() == rows.count() == 4 and rejected.count() == 2  # whatever columns are read
    assert rows.columns == ["a", "b"]


def test_header_is_read_without_a_job(spark, tmp_path):
    (tmp_path / "h.csv").write_text('﻿Prospect ID,"City, state",,City\nx,y,z,w\n')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("header", "header")
    try:
        assert tb.csv_header(spark, str(tmp_path)) == ["Prospect ID", "City, state", "_c2", "City"]
        rows, _ = tb.scan_leads_csv(spark, str(tmp_path))
        assert list(tracker.getJobIdsForGroup("header")) == []
        assert tuple(rows.first()) == ("x", "y", "z", "w")
    finally:
        spark.sparkContext.setJobGroup("", "")
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        tb.csv_header(spark, str(tmp_path / "none"))


def test_header_names_that_repeat_and_compressed_files(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a,A,_rejected_line\n1,2,3\n4,5\n")
    rows, rejected = tb.scan_leads_csv(spark, str(tmp_path))
    assert rows.columns == ["a", "A1", "_rejected_line"] and tuple(rows.first()) == ("1", "2", "3")
    assert [r["line"] for r in rejected.collect()] == ["4,5"]
