"""Profiling operators against numpy / brute force on small frames."""

import random

import numpy as np
import pytest

from propensity.constants import BOOLEAN_FEATURES, MODEL_FEATURES, NUMERIC_FEATURES
from propensity.operators import profile as pf


def test_events_by_type_zero_filled(spark):
    ev = spark.createDataFrame([("page_view",), ("page_view",), ("email_open",)], "event_type string")
    out = {r["event_type"]: (r["count"], r["pct"]) for r in pf.events_by_type(ev).collect()}
    assert out["page_view"] == (2, pytest.approx(200 / 3)) and out["email_unsubscribe"] == (0, 0.0)
    assert len(out) == 5
    empty = spark.createDataFrame([], "event_type string")
    assert all(v == (0, 0.0) for v in {r[0]: (r[1], r[2]) for r in pf.events_by_type(empty).collect()}.values())


def test_histogram_matches_numpy(spark):
    rnd = random.Random(4)
    vals = [rnd.uniform(-5, 20) for _ in range(500)] + [None] * 5
    df = spark.createDataFrame([(v, 3.0) for v in vals], "a double, c double")
    got = {(r["column_name"], r["bin"]): r["count"] for r in pf.histogram(df, ["a", "c"], bins=40).collect()}
    expected, _ = np.histogram([v for v in vals if v is not None], bins=40)
    assert [got[("a", i)] for i in range(40)] == list(expected)
    const, _ = np.histogram([3.0] * len(vals), bins=40)
    assert [got[("c", i)] for i in range(40)] == list(const)


def test_correlation_matches_numpy(spark):
    rnd = random.Random(8)
    rows = [(rnd.random(), rnd.random() * 3, rnd.randint(0, 1)) for _ in range(200)]
    rows[3] = (None, rows[3][1], rows[3][2])
    df = spark.createDataFrame(rows, "x double, y double, z int")
    got = {(r["var_a"], r["var_b"]): r["corr"] for r in pf.correlation_matrix(df, ["x", "y", "z"]).collect()}
    keep = [r for r in rows if r[0] is not None]
    cx = np.corrcoef([r[0] for r in keep], [r[1] for r in keep])[0, 1]
    assert got[("x", "y")] == pytest.approx(cx) and got[("y", "x")] == pytest.approx(cx)
    assert got[("z", "z")] == 1.0 and len(got) == 9


def test_top_values_ties_and_k(spark):
    vals = ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + [None] * 9 + [f"v{i}" for i in range(20)]
    df = spark.createDataFrame([(v,) for v in vals], "city string")
    out = pf.top_values(df, ["city"], k=4).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["rank"]) for r in out] == [("a", 3, 1), ("b", 3, 2), ("c", 2, 3),
                                                                   ("v0", 1, 4)]


def test_conversion_by_orders_and_limits(spark):
    df = spark.createDataFrame([("s1", True), ("s1", False), ("s2", True), ("s3", None), (None, True)],
                               "lead_source string, converted boolean")
    out = [(r[0], r[1], r[2]) for r in pf.conversion_by(df, "lead_source", k=2).collect()]
    assert out == [("s2", 100.0, 1), ("s1", 50.0, 2)]
    o = pf.conversion_overall(df).first()
    assert (o["total"], o["converted_count"], o["conversion_rate_pct"]) == (5, 3, 60.0)


def test_assembled_vector_order_and_booleans(spark):
    from pyspark.ml.functions import vector_to_array
    from propensity.operators.model import assemble_features
    row = tuple(float(i) for i in range(len(NUMERIC_FEATURES))) + tuple(i % 2 == 0 for i in range(len(BOOLEAN_FEATURES)))
    schema = ", ".join([f"{c} double" for c in NUMERIC_FEATURES] + [f"{c} boolean" for c in BOOLEAN_FEATURES])
    df = spark.createDataFrame([row], schema)
    vec = assemble_features().transform(df).select(vector_to_array("features")).first()[0]
    assert vec == [float(i) for i in range(12)] + [1.0, 0.0, 1.0, 0.0, 1.0]
    assert assemble_features().getInputCols() == list(MODEL_FEATURES)
