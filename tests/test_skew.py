"""A lead owning a third of all events: salted and unsalted plans agree, and the
salted join really runs on (lead_id, salt) when broadcasting is off."""

import random
from datetime import datetime, timedelta

from propensity.operators.features import feature_matrix

SCHEMA = "event_id long, lead_id long, event_type string, event_name string, properties string, occurred_at timestamp_ntz"


def skewed_events(spark, n=3000):
    rnd = random.Random(11)
    base = datetime(2024, 1, 1)
    types = ["page_view", "email_open", "email_click", "form_submission", "email_unsubscribe"]
    rows = []
    for i in range(n):
        lead = 0 if i % 3 == 0 else rnd.randint(1, 200)  # lead 0 owns a third of the rows
        t = rnd.choice(types)
        name = rnd.choice(["Pricing", "Blog Post", "Demo Request", None])
        props = '{"session_id": "s%d"}' % rnd.randint(0, 30) if t == "page_view" and rnd.random() < 0.8 else None
        rows.append((i, lead, t, name, props, base + timedelta(minutes=rnd.randint(0, 60 * 24 * 40))))
    return spark.createDataFrame(rows, SCHEMA)


def test_salted_equals_unsalted(spark):
    ev = skewed_events(spark)
    leads = spark.createDataFrame([(i, datetime(2024, 1, 20) + timedelta(hours=i)) for i in range(0, 205)],
                                  "lead_id long, as_of timestamp_ntz")
    a = {r["lead_id"]: r.asDict() for r in feature_matrix(leads, ev, as_of_col="as_of", salt_buckets=1).collect()}
    b = {r["lead_id"]: r.asDict() for r in feature_matrix(leads, ev, as_of_col="as_of", salt_buckets=8).collect()}
    c = {r["lead_id"]: r.asDict() for r in
         feature_matrix(leads, ev, as_of_col="as_of", rows_per_task=100).collect()}  # lead 0 gets 10 buckets
    assert a == b == c and len(a) == 205
    assert a[0]["total_pageviews_30d"] > 100


def test_hot_keys(spark):
    from propensity.operators.features import hot_keys
    ev = skewed_events(spark)
    hot = {r[0]: r[1] for r in hot_keys(ev, rows_per_task=100).collect()}
    assert hot == {0: 10}


def test_requested_events_spread_a_hot_lead(spark):
    from propensity.operators.features import _events_for_features, requested_events
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = _events_for_features(skewed_events(spark))
        got = requested_events(ev, spark.createDataFrame([(0,), (3,), (999,)], "lead_id long"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_salt" in plan
        assert got.count() == ev.where("lead_id in (0, 3)").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_salted_plan_without_broadcast(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ev = skewed_events(spark, 300)
        leads = spark.createDataFrame([(i, datetime(2024, 1, 20)) for i in range(0, 205)],
                                      "lead_id long, as_of timestamp_ntz")
        for kwargs in ({"salt_buckets": 8}, {"rows_per_task": 10}):
            df = feature_matrix(leads, ev, as_of_col="as_of", **kwargs)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "_pit_salt" in plan and "SortMergeJoin" in plan
            assert df.count() == 205
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_many_requested_leads_are_not_broadcast(spark, tmp_path):
    from propensity.operators.features import _events_for_features, requested_events
    ev = _events_for_features(skewed_events(spark))
    spark.range(300).withColumnRenamed("id", "lead_id").write.parquet(str(tmp_path / "leads"))
    leads = spark.read.parquet(str(tmp_path / "leads"))  # a file of a few hundred bytes
    plans = [requested_events(ev, leads, broadcast_rows=n) for n in (299, 300)]
    many, few = (p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert "SortMergeJoin" in many and "BroadcastHashJoin" not in many and "BroadcastHashJoin" in few
    assert plans[0].count() == plans[1].count() == ev.where("lead_id < 300").count()
