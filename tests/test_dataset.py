"""Cut-off rule, labelled filter and time split."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from propensity.functions.time import as_of_date
from propensity.operators import dataset as ds

NOW = datetime(2024, 6, 1)
CREATED = datetime(2024, 1, 1)


@pytest.mark.parametrize("converted,converted_at,latest,expected", [
    (True, datetime(2024, 3, 1), None, datetime(2024, 2, 29)),
    (False, None, None, CREATED + timedelta(days=90)),
    (False, None, datetime(2024, 2, 1), datetime(2024, 2, 1)),
    (True, None, datetime(2024, 5, 1), CREATED + timedelta(days=90)),
    (False, None, datetime(2024, 5, 30), CREATED + timedelta(days=90)),
])
def test_as_of(spark, converted, converted_at, latest, expected):
    df = spark.createDataFrame([(converted, converted_at, CREATED, latest)],
                               "c boolean, ca timestamp_ntz, cr timestamp_ntz, le timestamp_ntz")
    got = df.select(as_of_date(F.col("c"), F.col("ca"), F.col("cr"), F.col("le"), NOW).alias("a")).first()["a"]
    assert got == expected


def test_labelled(spark):
    df = spark.createDataFrame([(1, True, datetime(2024, 1, 1)), (2, True, None), (3, None, None), (4, False, None)],
                               "lead_id long, converted boolean, converted_at timestamp_ntz")
    assert sorted(r[0] for r in ds.labelled(df).select("lead_id").collect()) == [1, 4]
    with pytest.raises(ValueError):
        ds.require_rows(ds.labelled(df.where("lead_id = 2")))


def test_time_split(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=(i * 7) % 10)) for i in range(10)]
    df = spark.createDataFrame(rows, "lead_id long, as_of timestamp_ntz")
    out = ds.time_split(df, partitions=3).collect()
    train = [r for r in out if r["split"] == "train"]
    test = [r for r in out if r["split"] == "test"]
    assert len(train) == 8 and len(test) == 2
    assert max(r["as_of"] for r in train) <= min(r["as_of"] for r in test)


def by_sort(rows, fraction):
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0]))
    cut = int(len(rows) * (1.0 - fraction))
    return {r[0]: "train" if i < cut else "test" for i, r in enumerate(ordered)}


@pytest.mark.parametrize("fraction", [0.2, 0.5, 0.37, 0.0, 1.0])
@pytest.mark.parametrize("days", [1, 2, 7, 400])
def test_time_split_equals_a_sort(spark, fraction, days):
    """Few and many ties, a null time, cuts inside and between ties."""
    rows = [(i, None if i % 50 == 49 else datetime(2024, 1, 1) + timedelta(days=(i * 13) % days, microseconds=days % 3))
            for i in range(123)]
    df = spark.createDataFrame(rows, "lead_id long, as_of timestamp_ntz")
    got = {r["lead_id"]: r["split"] for r in ds.time_split(df, test_fraction=fraction).collect()}
    assert got == by_sort(rows, fraction)


def test_time_split_of_nothing_and_of_text_keys(spark):
    df = spark.createDataFrame([], "lead_id long, as_of timestamp_ntz")
    assert ds.time_split(df).collect() == []
    df = spark.createDataFrame([(k, 1) for k in "cabed"], "lead_id string, as_of int")
    assert {r["lead_id"] for r in ds.time_split(df, test_fraction=0.4).where("split = 'train'").collect()} == set("abc")


def test_time_split_moves_no_wide_rows(spark):
    """The split of wide rows is a projection: nothing of them is exchanged, sorted or written."""
    df = spark.range(500).select(F.col("id").alias("lead_id"), (F.col("id") % 9).alias("as_of"),
                                 *[F.rand(i).alias(f"x{i}") for i in range(20)])
    text = ds.time_split(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in text for w in ("Exchange", "Sort", "Window", "Join", "Scan ExistingRDD"))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_time_split_in_other_time_zones(spark, kind, zone, tmp_path):
    """The cut goes through the driver unchanged, also in the hour that a clock change repeats."""
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        # instants half an hour apart around 2024-11-03 06:00 UTC, each three times
        micros = [1730610000_000000 + (i // 3) * 1800_000000 for i in range(30)]
        df = spark.createDataFrame(list(enumerate(micros)), "lead_id long, m long").select(
            "lead_id", "m", F.timestamp_micros("m").cast(kind).alias("as_of"))
        df.repartition(3).write.parquet(f"{tmp_path}/t")  # stored values: a cast in the plan would be folded into the comparison
        df = spark.read.parquet(f"{tmp_path}/t")
        order = [r["lead_id"] for r in df.orderBy("as_of", "lead_id").collect()]
        for fraction in (0.2, 0.5, 0.63):
            got = ds.time_split(df, test_fraction=fraction).where("split = 'train'").collect()
            assert {r["lead_id"] for r in got} == set(order[:int(30 * (1 - fraction))])
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
