"""Buckets, top factors, versions, registry, CRM rules."""

import pytest
from pyspark.sql import functions as F

from propensity.functions import rules as ru
from propensity.functions import scoring as fs
from propensity.operators import registry as rg


@pytest.mark.parametrize("score,bucket", [(0.85, "A"), (0.7, "A"), (0.5, "B"), (0.4, "B"), (0.3, "C"),
                                          (0.2, "C"), (0.1, "D"), (None, None)])
def test_bucket(spark, score, bucket):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(fs.score_bucket("s")).first()[0] == bucket


def test_top_factors_global_order():
    names = [f"f{i}" for i in range(6)]
    top = fs.ordered_factors(names, [.05, .30, .10, .25, .20, .10])
    assert [n for n, _ in top[:2]] == ["f1", "f3"] and len(top) == 5


def test_top_factors_column(spark):
    df = spark.createDataFrame([(1, True, 3)], "id long, a boolean, b long")
    r = df.select(fs.top_factors(["a", "b"], [0.2, 0.8], n=2).alias("t")).first()["t"]
    assert [x["feature"] for x in r] == ["b", "a"] and r[1]["value"] == "true"


def test_top_factors_by_row(spark):
    df = spark.createDataFrame([([0.1, -0.9, 0.5],)], "imp array<double>")
    r = df.select(fs.top_factors_by_row(["x", "y", "z"], F.col("imp"), n=2).alias("t")).first()["t"]
    assert [x["feature"] for x in r] == ["y", "z"]


@pytest.mark.parametrize("versions,expected", [([], "v1.0"), (["v1.2", "v1.0", "v1.1"], "v1.3"),
                                               (["v1.0", "v2.0"], "v2.1"), (["v1.9", "v1.10"], "v1.11"),
                                               (["v3"], "v1.0")])
def test_next_version(spark, versions, expected):
    df = spark.createDataFrame([(v,) for v in versions], "version string")
    assert rg.next_version(df).first()[0] == expected


def test_register_model_deactivates(spark):
    reg = rg.empty_registry(spark)
    reg = rg.register_model(reg, "v1.0", "m/v1.0", {"auc_roc": 0.9}, {}, ["a"], set_active=True)
    reg = rg.register_model(reg, "v1.1", "m/v1.1", {"auc_roc": 0.92}, {}, ["a"], set_active=True)
    assert [r["version"] for r in rg.active(reg).collect()] == ["v1.1"]
    assert rg.require_single_active(reg)["version"] == "v1.1"
    with pytest.raises(LookupError):
        rg.require_single_active(rg.empty_registry(spark))


def test_crm_rules(spark):
    df = spark.createDataFrame([("5", "SaaS", "VP Sales"), ("11-50", "SaaS", "Engineer"), ("weird", "Retail", None)],
                               "size string, industry string, title string")
    rows = df.select(ru.normalize_company_size("size").alias("b"),
                     ru.icp_match(F.col("industry"), ru.normalize_company_size("size")).alias("icp"),
                     ru.is_decision_maker("title").alias("dm")).collect()
    assert [r["b"] for r in rows] == ["1-10", "11-50", "unknown"]
    assert [r["icp"] for r in rows] == [False, True, False]
    assert [r["dm"] for r in rows] == [True, False, False]
    out = ru.crm_rename(spark.createDataFrame([(0.5, "A")], "score double, bucket string"), "salesforce")
    assert out.columns == ["Lead_Score__c", "Lead_Score_Bucket__c"]
