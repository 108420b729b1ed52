"""Cleaning and loading cases of the original ingestion tests."""

from propensity.operators import cleaning as cl
from propensity.sources.tables import read_leads_csv


def col(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


def test_placeholders(spark):
    df = spark.createDataFrame([("Data Science",), ("Select",), ("select",), ("",), ("   ",), ("\tMumbai\n",),
                                ("Specialization",), ("SELECT",)], "`Specialization` string")
    assert col(cl.replace_placeholders(df), "Specialization") == [
        "Data Science", None, None, None, None, "Mumbai", "Specialization", None]


def test_yes_no(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("maybe",), (None,)], "`Do Not Email` string")
    assert col(cl.convert_booleans(df), "Do Not Email") == [True, False, False, False]


def test_label(spark):
    df = spark.createDataFrame([("1",), ("0",), ("99",), (None,), ("1.0",), ("abc",)], "Converted string")
    assert col(cl.convert_booleans(df), "Converted") == [True, False, None, None, True, None]


def test_numerics(spark):
    df = spark.createDataFrame([("abc",), ("5",), ("",), ("5d",), ("1e1",), ("-2.5",), (".5",)], "TotalVisits string")
    assert col(cl.coerce_numerics(df), "TotalVisits") == [None, 5.0, None, None, 10.0, -2.5, 0.5]


def test_rename_drops_unmapped_and_tolerates_missing(spark):
    df = spark.createDataFrame([("a", "1", "x")], "`Prospect ID` string, `Lead Number` string, `City` string")
    out = cl.rename_columns(df)
    assert out.columns == ["external_id", "city"]


def test_required(spark):
    df = spark.createDataFrame([("abc-001",), (None,), ("",), ("   ",)], "external_id string")
    valid, rejected = cl.split_required(df)
    assert valid.count() == 1 and rejected.count() == 3


def test_csv_fixture_end_to_end(spark, tmp_path):
    p = tmp_path / "leads.csv"
    p.write_text(
        "Prospect ID,Lead Origin,Lead Source,Do Not Email,Do Not Call,Converted,TotalVisits,"
        "Total Time Spent on Website,Page Views Per Visit,Last Activity,Country,Specialization,"
        "What is your current occupation,City,Tags,Lead Number\n"
        "abc-001,API,Google,No,No,1,5,100,2.5,Email Opened,India,Finance,Student,Mumbai,x,1\n"
        "abc-002,API,Select,Yes,No,0,,,,SMS Sent,India,Select,Select,Select,,2\n"
        "abc-003,API,, ,Yes,0,3,10,1,SMS Sent,,,,,,3\n"
        ",API,Google,No,No,1,5,100,2.5,Email Opened,India,Finance,Student,Mumbai,x,4\n"
        "abc-005,API,Google,maybe,nah,0,text,abc,2,Email Opened,India,Finance,Student,Mumbai,x,5\n"
        "abc-006,API,Google,No,No,,5,100,2.5,Email Opened,  ,  Specialization  ,Student,  Mumbai  ,x,6\n"
        "abc-001,API,Google,No,No,0,5,100,2.5,Email Opened,India,Finance,Student,Mumbai,x,7\n")
    raw = read_leads_csv(spark, str(p)).withColumn("input_order", __import__("pyspark.sql.functions",
                                                                            fromlist=["col"]).col("Lead Number").cast("int"))
    valid, rejected = cl.prepare_load(raw)
    rows = {r["input_order"]: r for r in valid.collect()}
    assert rejected.count() == 1 and len(rows) == 6
    assert rows[1]["do_not_email"] is False and rows[1]["converted"] is True and rows[1]["total_visits"] == 5.0
    assert rows[2]["specialization"] is None and rows[2]["city"] is None and rows[2]["do_not_email"] is True
    assert rows[3]["do_not_call"] is True
    assert rows[5]["do_not_email"] is False and rows[5]["total_visits"] is None and rows[5]["total_time_spent"] is None
    assert rows[6]["converted"] is None and rows[6]["country"] is None
    assert rows[6]["specialization"] == "Specialization" and rows[6]["city"] == "Mumbai"
    first = cl.rows_to_insert(None, valid)
    assert first.count() == 5  # the repeated abc-001 (row 7) loses to row 1
    assert first.where("external_id = 'abc-001'").first()["input_order"] == 1
    again = cl.rows_to_insert(first, valid)
    assert again.count() == 0
    s = cl.load_summary(raw).first()
    assert (s["total_read"], s["total_rejected"], s["total_skipped"], s["total_inserted"]) == (7, 1, 1, 5)
    assert cl.load_summary(raw)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    s = cl.load_summary(raw.limit(0), first).first()
    assert tuple(s) == (0, 0, 0, 0, 0.0)
    s = cl.load_summary(raw, first).first()
    assert (s["total_read"], s["total_rejected"], s["total_skipped"], s["total_inserted"]) == (7, 1, 6, 0)


def test_null_percentages(spark):
    df = spark.createDataFrame([(None, 1.0, "kaggle"), ("a", None, "kaggle"), ("b", None, "kaggle")],
                               "a string, b double, source_system string")
    out = {r[0]: r[1] for r in cl.null_percentages(df).collect()}
    assert out == {"a": 33.3, "b": 66.7}
