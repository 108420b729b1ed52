"""Sessions that no deployment has prepared."""

import os
import subprocess
import sys
import textwrap

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code: str, tmp_path, **env) -> subprocess.CompletedProcess:
    """``code`` in a process of its own, with an empty Spark configuration folder."""
    conf = tmp_path / "conf"
    conf.mkdir(exist_ok=True)
    clean = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_SUBMIT_ARGS"}
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, cwd=ROOT,
                          env={**clean, "SPARK_CONF_DIR": str(conf), "PYTHONPATH": ROOT, **env})


def test_local_session_without_a_checkpoint_folder(tmp_path):
    done = run("""
        from propensity.session import checkpoint, checkpoint_dir, get_spark, scratch_path
        spark = get_spark(master="local[2]", shuffle_partitions=2)
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        first = checkpoint_dir(spark)
        assert checkpoint_dir(spark) == first and scratch_path(spark, "x").startswith(first)
        assert checkpoint(spark.range(10)).count() == 10
        import __spark_entry__
        assert __spark_entry__.entry(spark).count() > 0
    """, tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_named_folder_is_used(tmp_path):
    shared = tmp_path / "shared"
    done = run(f"""
        from pyspark.sql import SparkSession
        SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{shared}").config(
            "spark.ui.enabled", "false").getOrCreate()
        from propensity.session import checkpoint_dir, get_spark
        assert "{shared}" in checkpoint_dir(get_spark())
    """, tmp_path)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize("master", ["local-cluster[1,1,1024]", "spark://host:7077", "yarn"])
def test_a_cluster_must_name_a_folder(monkeypatch, master):
    from propensity import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    Session.sparkContext.master = master
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_scratch_scope_deletes_its_tables(spark):
    from propensity.session import checkpoint_dir, scratch_path, scratch_scope
    from propensity.sources import files

    def table(n):
        path = scratch_path(spark, f"t{n}")
        spark.range(n).write.parquet(path)
        return path

    base = checkpoint_dir(spark)
    with scratch_scope(spark) as outer:
        kept = table(5)
        with pytest.raises(ZeroDivisionError), scratch_scope(spark, "inner") as inner:
            lost = table(7)
            assert lost.startswith(inner) and inner.startswith(outer) and outer.startswith(base)
            1 / 0
        assert files.names(spark, inner) == [] and spark.read.parquet(kept).count() == 5
        assert scratch_path(spark, "x") == f"{outer}/x"
    assert files.names(spark, outer) == [] and scratch_path(spark, "x") == f"{base}/x"
    assert not files.remove(spark, outer)


def test_scratch_scope_around_an_operator(spark):
    """An update stages its partitions inside the scope and leaves nothing but its result."""
    from propensity.operators import joins
    from propensity.session import checkpoint_dir, scratch_path, scratch_scope
    target = scratch_path(spark, f"scoped-{os.urandom(8).hex()}")
    spark.range(20).selectExpr("id", "id % 4 as part", "0 as v").write.partitionBy("part").parquet(target)
    before = set(os.listdir(checkpoint_dir(spark).removeprefix("file:")))
    with scratch_scope(spark):
        changes = spark.range(3).selectExpr("id", "9 as v")
        assert len(joins.update_partitions(spark, target, changes, "id", ["v"], ("part",))) == 3
    assert spark.read.parquet(target).where("v = 9").count() == 3
    left = set(os.listdir(checkpoint_dir(spark).removeprefix("file:"))) - before
    assert not any(n.startswith(("run-", "update-")) for n in left)
