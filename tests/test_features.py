"""Feature semantics on hand-built events (cases of the original unit tests)."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from propensity.functions import checked as ck
from propensity.catalogue import Catalogue, by_origin, catalogue_table, default_catalogue, with_builder
from propensity.operators.features import (apply_defaults, apply_defaults_counted, feature_failures, feature_matrix,
                                            invalid_feature_report)

AS_OF = datetime(2024, 3, 10, 12, 0, 0)
SCHEMA = "lead_id long, event_type string, event_name string, properties string, occurred_at timestamp_ntz"


def fm(spark, events, as_of=AS_OF, leads=(1,)):
    ev = spark.createDataFrame(events, SCHEMA)
    ld = spark.createDataFrame([(x,) for x in leads], "lead_id long")
    return {r["lead_id"]: r.asDict() for r in feature_matrix(ld, ev, as_of=as_of).collect()}


def e(kind, days_before, name=None, props=None, lead=1, as_of=AS_OF):
    return (lead, kind, name, props, as_of - timedelta(days=days_before))


def test_recency(spark):
    r = fm(spark, [e("page_view", 3), e("page_view", 10)])[1]
    assert r["days_since_last_visit"] == 3
    assert r["days_since_last_email_open"] == 365
    assert fm(spark, [])[1]["days_since_last_visit"] == 365


def test_first_touch(spark):
    r = fm(spark, [e("page_view", 30), e("email_open", 10)])[1]
    assert r["days_since_first_touch"] == 30
    assert fm(spark, [])[1]["days_since_first_touch"] == 0


def test_whole_days_floor(spark):
    # 1 day 23 hours before as_of is one whole day, not two calendar days
    ev = [(1, "page_view", None, None, AS_OF - timedelta(days=1, hours=23))]
    assert fm(spark, ev)[1]["days_since_last_visit"] == 1


def test_windows(spark):
    r = fm(spark, [e("page_view", 1), e("page_view", 6), e("page_view", 8), e("page_view", 7)])[1]
    assert r["total_pageviews_7d"] == 3  # exactly -7 d counts
    r = fm(spark, [e("page_view", 1), e("page_view", 15), e("page_view", 29), e("page_view", 31), e("page_view", 30)])[1]
    assert r["total_pageviews_30d"] == 4  # exactly -30 d counts


def test_as_of_is_exclusive(spark):
    r = fm(spark, [e("page_view", 0)])[1]
    assert r["total_pageviews_7d"] == 0 and r["days_since_last_visit"] == 365


def test_sessions(spark):
    s = lambda x: '{"session_id": "%s"}' % x
    ev = [e("page_view", 1, props=s("s1")), e("page_view", 2, props=s("s2")), e("page_view", 3, props=s("s1")),
          e("page_view", 365, props=s("s3")), e("page_view", 4, props="{}"), e("page_view", 4, props=None),
          e("page_view", 4, props='{"session_id": ""}'), e("email_open", 1, props=s("s9"))]
    assert fm(spark, ev)[1]["total_sessions"] == 3


def test_pages_per_session(spark):
    s = lambda x: '{"session_id": "%s"}' % x
    r = fm(spark, [e("page_view", 1, props=s("A")), e("page_view", 2, props=s("A")),
                   e("page_view", 3, props=s("A")), e("page_view", 4, props=s("B"))])[1]
    assert r["avg_pages_per_session"] == 2.0
    r = fm(spark, [e("page_view", 1, props="{}"), e("page_view", 1, props=None), e("page_view", 2, props=s("A"))])[1]
    assert r["avg_pages_per_session"] == 1.0


def test_session_duration(spark):
    base = AS_OF - timedelta(days=1)
    ev = [(1, "page_view", None, '{"session_id": "A"}', base),
          (1, "page_view", None, '{"session_id": "A"}', base + timedelta(seconds=120)),
          (1, "page_view", None, '{"session_id": "B"}', base)]
    assert fm(spark, ev)[1]["avg_session_duration_seconds"] == 60.0


@pytest.mark.parametrize("recent,older,unsub_recent,expected", [(3, 1, 0, 2), (1, 3, 0, -2), (0, 1, 1, -2)])
def test_velocity(spark, recent, older, unsub_recent, expected):
    ev = [e("page_view", 1) for _ in range(recent)] + [e("page_view", 5) for _ in range(older)] + \
         [e("email_unsubscribe", 1) for _ in range(unsub_recent)]
    r = fm(spark, ev)[1]
    assert r["engagement_velocity_7d"] == expected
    assert r["is_engagement_increasing"] is (expected > 0)


def test_velocity_mixed_and_outside(spark):
    r = fm(spark, [e("email_unsubscribe", 1), e("page_view", 1), e("page_view", 5)])[1]
    assert r["engagement_velocity_7d"] == -1
    assert fm(spark, [e("page_view", 10)])[1]["engagement_velocity_7d"] == 0


def test_intent_requires_type(spark):
    r = fm(spark, [e("page_view", 1, name="Pricing"), e("form_submission", 1, name="Demo Request")])[1]
    assert r["viewed_pricing"] and r["requested_demo"] and r["pricing_page_views"] == 1
    r = fm(spark, [e("email_click", 1, name="Pricing"), e("page_view", 1, name="Demo Request")])[1]
    assert not r["viewed_pricing"] and not r["requested_demo"]


def test_point_in_time_per_lead(spark):
    as_of = datetime(2024, 3, 10)
    ev = spark.createDataFrame([(1, "page_view", None, None, datetime(2024, 3, 5)),
                                (1, "page_view", None, None, datetime(2024, 3, 12))], SCHEMA)
    ld = spark.createDataFrame([(1, as_of)], "lead_id long, as_of timestamp_ntz")
    for salt in (1, 4):
        r = feature_matrix(ld, ev, as_of_col="as_of", salt_buckets=salt).first()
        assert r["days_since_last_visit"] == 5 and r["total_pageviews_7d"] == 1


def test_firmographics_default_and_all_20(spark):
    r = fm(spark, [e("page_view", 1)])[1]
    assert r["company_size_bucket"] == "unknown" and r["industry_match_icp"] is False
    assert set(default_catalogue.names) <= set(r)


def test_validation_defaults(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), "huge", None)],
                               "lead_id long, days_since_last_visit double, avg_pages_per_session double, "
                               "company_size_bucket string, viewed_pricing boolean")
    r = apply_defaults(df).first()
    assert r["days_since_last_visit"] == 365 and r["avg_pages_per_session"] == 0.0
    assert r["company_size_bucket"] == "unknown" and r["viewed_pricing"] is False
    assert len([c for c in r.asDict() if c not in ("lead_id",)]) == 20
    rep = invalid_feature_report(df).collect()
    assert {x["feature"] for x in rep} == {"days_since_last_visit", "avg_pages_per_session", "company_size_bucket"}


def test_validation_of_wrong_types(spark):
    df = spark.createDataFrame([(1, "5", "abc", 2.5, "yes", 1, True, 7)],
                               "lead_id long, days_since_last_visit string, total_sessions string, total_pageviews_7d double, "
                               "viewed_pricing string, requested_demo int, emails_opened_30d boolean, company_size_bucket int")
    r = apply_defaults(df).first()
    assert r["days_since_last_visit"] == 365 and r["total_sessions"] == 0 and r["total_pageviews_7d"] == 2.5
    assert r["viewed_pricing"] is False and r["requested_demo"] is False and r["emails_opened_30d"] == 1
    assert r["company_size_bucket"] == "unknown"
    rep = {x["feature"]: (x["value"], x["default_value"]) for x in invalid_feature_report(df).collect()}
    assert rep == {"days_since_last_visit": ("5", "365"), "total_sessions": ("abc", "0"), "viewed_pricing": ("yes", "false"),
                   "requested_demo": ("1", "false"), "company_size_bucket": ("7", "unknown")}


def test_catalogue_registry(spark):
    computed, defaulted = by_origin(Catalogue())
    assert not computed & defaulted and computed | defaulted == set(Catalogue().names)
    assert defaulted == {"company_size_bucket", "industry_match_icp", "job_title_seniority"}
    with pytest.raises(KeyError):
        with_builder(Catalogue(), "no_such_feature", lambda as_of: F.lit(1))
    cat = with_builder(Catalogue(), "company_size_bucket", lambda as_of: F.lit("1-10"))
    assert "company_size_bucket" in by_origin(cat)[0] and not Catalogue().builders
    ev = spark.createDataFrame([e("page_view", 1)], SCHEMA)
    ld = spark.createDataFrame([(1,)], "lead_id long")
    assert feature_matrix(ld, ev, as_of=AS_OF, catalogue=cat).first()["company_size_bucket"] == "1-10"
    assert cat["days_since_last_visit"].default == 365
    assert cat["job_title_seniority"].categories[0] == "unknown"
    assert catalogue_table(spark, cat).count() == 20


def test_failing_builder_is_isolated(spark):
    bad = lambda as_of: F.max(F.col("no_such_column"))
    cat = with_builder(Catalogue(), "company_size_bucket", bad)
    cat = with_builder(cat, "total_pageviews_7d", bad)  # not filled by the built-in value either
    cat = with_builder(cat, "job_title_seniority", lambda as_of: F.lit("manager"))
    ev = spark.createDataFrame([e("page_view", 1)], SCHEMA)
    ld = spark.createDataFrame([(1,)], "lead_id long")
    r = feature_matrix(ld, ev, as_of=AS_OF, catalogue=cat).first()
    assert r["company_size_bucket"] == "unknown" and r["job_title_seniority"] == "manager"
    assert r["total_pageviews_7d"] == 0
    assert r["days_since_last_visit"] == 1


def test_booleans_are_numbers(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, False), (3, None, None)],
                               "lead_id long, total_sessions boolean, avg_pages_per_session boolean")
    got = {r["lead_id"]: (r["total_sessions"], r["avg_pages_per_session"]) for r in apply_defaults(df).collect()}
    assert got == {1: (1, 1.0), 2: (0, 0.0), 3: (0, 0.0)} and invalid_feature_report(df).isEmpty()


def test_invalid_values_are_counted_in_the_same_pass(spark, tmp_path):
    rows = [(i, float("nan") if i % 3 == 0 else 1.0, "5" if i % 2 else None, ["manager", "boss"][i % 5 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "lead_id long, days_since_last_visit double, total_sessions string, job_title_seniority string")
    df.write.parquet(f"{tmp_path}/in")
    out, seen = apply_defaults_counted(spark.read.parquet(f"{tmp_path}/in").repartition(5))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    out.write.parquet(f"{tmp_path}/out")
    report = {r["feature"]: r["count"] for r in invalid_feature_report(df).groupBy("feature").count().collect()}
    assert seen.get == {"rows": 60, **report} and report == {"days_since_last_visit": 20, "total_sessions": 30, "job_title_seniority": 12}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
    nothing, seen = apply_defaults_counted(df.limit(0))
    assert nothing.count() == 0 and set(seen.get.values()) == {0}


def failing(text):
    cat = with_builder(Catalogue(), "total_sessions", lambda a: ck.checked_sum(ck.checked_cast(F.col("event_name"), "int")))
    cat = with_builder(cat, "avg_pages_per_session", lambda a: ck.checked_divide(
        ck.checked_count(F.col("event_type") == "page_view"), ck.checked_count(F.col("event_type") == "email_open")))
    cat = with_builder(cat, "total_pageviews_30d", lambda a: F.sum(F.col("event_name").cast("int")))
    cat = with_builder(cat, "emails_clicked_30d", lambda a: 1 / 0)
    return cat


def test_features_that_fail_on_data_are_isolated(spark):
    rows = [e("page_view", 1, name="3"), e("email_open", 1, name="4"), e("page_view", 2, lead=2, name="x"),
            e("page_view", 3, lead=2, name="5"), e("page_view", 3, lead=3, name="7")]
    ev = spark.createDataFrame(rows, SCHEMA)
    ld = spark.createDataFrame([(1,), (2,), (3,), (4,)], "lead_id long")
    cat = failing(None)
    got = {r["lead_id"]: r for r in feature_matrix(ld, ev, as_of=AS_OF, catalogue=cat).collect()}
    plain = {r["lead_id"]: r for r in feature_matrix(ld, ev, as_of=AS_OF).collect()}
    assert {k: r["total_sessions"] for k, r in got.items()} == {1: 7, 2: 0, 3: 7, 4: 0}
    assert {k: r["avg_pages_per_session"] for k, r in got.items()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert {k: r["total_pageviews_30d"] for k, r in got.items()} == {1: 7, 2: 5, 3: 7, 4: 0}
    others = [n for n in default_catalogue.names if n not in cat.builders]
    assert all(got[k][n] == plain[k][n] for k in got for n in others) and got[1]["emails_clicked_30d"] == 0
    failed = sorted(map(tuple, feature_failures(ld, ev, cat, as_of=AS_OF).collect()))
    assert failed == [(2, "avg_pages_per_session", "division by zero"), (2, "total_sessions", "cannot cast 'x' to int"),
                      (3, "avg_pages_per_session", "division by zero")]
    assert feature_failures(ld, ev, default_catalogue, as_of=AS_OF).isEmpty()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"  # as it was


def test_checked_expressions(spark):
    df = spark.createDataFrame([(1, "4", [1, 2], 0), (1, None, None, 2), (2, "9223372036854775807", [5], 1), (2, "1", [6], 1)],
                               "g int, t string, a array<int>, d int")
    n, el = ck.checked_cast(F.col("t"), "bigint"), ck.checked_element(F.col("a"), F.lit(1))
    cols = {"sum": ck.checked_sum(n), "max": ck.checked_max(n), "min": ck.checked_min(n), "element": ck.checked_max(el),
            "ratio": ck.checked_max(ck.checked_divide(n, F.col("d")))}
    got = {r["g"]: r for r in df.groupBy("g").agg(*[x for k, c in cols.items() for x in (c.value.alias(k), c.error.alias(f"{k}_e"))]).collect()}
    assert (got[1]["sum"], got[1]["sum_e"], got[1]["element"], got[1]["element_e"]) == (4, None, 2, None)
    assert got[1]["ratio_e"] == "division by zero" and got[2]["sum_e"] == "sum overflows" and got[2]["element_e"] == "no element 1"
    assert (got[2]["max"], got[2]["min"], got[2]["ratio_e"]) == (2 ** 63 - 1, 1, None)
