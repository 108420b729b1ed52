"""Schema rules reported per row (NOT NULL, max length, CHECK, UNIQUE, FK) and
referential deletes."""

from datetime import datetime

from propensity.operators import constraints as cs
from propensity.operators import joins as jn


def rules(df):
    return {r[0]: sorted(r["violations"]) for r in df.collect()}


def test_lead_rules(spark):
    leads = spark.createDataFrame([
        ("a", "kaggle", None), ("a", "kaggle", None), (None, "kaggle", None),
        ("x" * 51, "kaggle", None), ("b", None, "t" * 201), ("c", "kaggle", "ok")],
        "external_id string, source_system string, tags string")
    leads = leads.selectExpr("monotonically_increasing_id() AS rid", "*").coalesce(1)
    out = {r["external_id"] or f"null-{r['rid']}": sorted(r["violations"]) for r in cs.lead_violations(leads).collect()}
    assert out["a"] == ["unique:external_id"]
    assert [v for k, v in out.items() if k.startswith("null-")] == [["not_null:external_id"]]
    assert out["x" * 51] == ["max_length:external_id"]
    assert out["b"] == ["max_length:tags", "not_null:source_system"]
    assert out["c"] == []


def test_event_rules(spark):
    leads = spark.createDataFrame([(1,)], "lead_id long")
    ev = spark.createDataFrame([(10, 1, "page_view", datetime(2024, 1, 1)), (11, 2, "page_view", datetime(2024, 1, 1)),
                                (12, 1, "meeting_booked", datetime(2024, 1, 1)), (13, 1, "email_open", None)],
                               "event_id long, lead_id long, event_type string, occurred_at timestamp_ntz")
    ev = ev.withColumn("event_name", ev.event_type.substr(1, 0))
    out = rules(cs.event_violations(ev, leads).select("event_id", "violations"))
    assert out == {10: [], 11: ["fk:lead_id"], 12: ["check:event_type"], 13: ["not_null:occurred_at"]}


def test_prediction_and_sync_rules(spark):
    leads = spark.createDataFrame([(1,)], "lead_id long")
    pred = spark.createDataFrame([(1, 0.5, "E", "v1.0", datetime(2024, 1, 1)), (1, 0.5, "A", "v1.0", datetime(2024, 1, 1))],
                                 "lead_id long, score double, bucket string, model_version string, scored_at timestamp_ntz")
    got = [sorted(r["violations"]) for r in cs.prediction_violations(pred, leads).collect()]
    assert sorted(got) == [[], ["check:bucket"]]
    logs = spark.createDataFrame([(1, "hubspot", "x", "push", None), (1, "hubspot", "x", "push", "done")],
                                 "lead_id long, source_system string, external_id string, action string, status string")
    defaulted = cs.with_defaults(logs, cs.SYNC_DEFAULTS)
    assert [r["status"] for r in defaulted.collect()] == ["pending", "done"]
    got = sorted(sorted(r["violations"]) for r in cs.sync_log_violations(defaulted, leads).collect())
    assert got == [[], ["check:status"]]


def test_cascade_and_restrict(spark):
    leads = spark.createDataFrame([(1,), (2,), (3,)], "lead_id long")
    ev = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "event_id long, lead_id long")
    pred = spark.createDataFrame([(2,)], "lead_id long")
    doomed = leads.where("lead_id IN (1, 2)")
    assert sorted(r[0] for r in jn.delete_cascade(doomed, ev).select("event_id").collect()) == [12]
    assert [r[0] for r in jn.delete_restricted(doomed, pred).collect()] == [2]


def test_update_and_traversal(spark):
    t = spark.createDataFrame([(1, None), (2, None)], "lead_id long, converted_at timestamp_ntz")
    u = spark.createDataFrame([(2, datetime(2024, 1, 5))], "lead_id long, converted_at timestamp_ntz")
    got = {r[0]: r[1] for r in jn.update_by_key(t, u, "lead_id", ["converted_at"]).collect()}
    assert got == {1: None, 2: datetime(2024, 1, 5)}
    kids = spark.createDataFrame([(1, "a"), (1, "b")], "lead_id long, v string")
    assert jn.nest_children(t, kids, prefix="ev_").columns == ["lead_id", "converted_at", "ev_v"]
