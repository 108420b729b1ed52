"""JSON property access tolerance and CSV missing-value tokens."""

from propensity.functions.json import json_nested, json_text, session_id
from propensity.sources.tables import read_leads_csv


def test_json_tolerant(spark):
    docs = ['{"session_id": "s1"}', '{"session_id": ""}', "{}", None, "not json", '{"a": {"b": [7, 8]}}']
    df = spark.createDataFrame([(d,) for d in docs], "p string")
    got = [r[0] for r in df.select(session_id("p")).collect()]
    assert got == ["s1", None, None, None, None, None]
    nested = [r[0] for r in df.select(json_nested("p", "$.a.b[1]", "int")).collect()]
    assert nested == [None, None, None, None, None, 8]
    assert [r[0] for r in df.select(json_text("p", "$.a.b[0]")).collect()][-1] == "7"


def test_csv_na_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Prospect ID,City\nx1,N/A\nx2,null\nx3,NaN\nx4,  \nx5,Mumbai\nx6,\n")
    rows = {r[0]: r[1] for r in read_leads_csv(spark, str(p)).collect()}
    assert rows == {"x1": None, "x2": None, "x3": None, "x4": "  ", "x5": "Mumbai", "x6": None}


def test_csv_quotes_and_backslashes_as_pandas_reads_them(spark, tmp_path):
    import pandas as pd
    from propensity.sources.tables import read_leads_csv
    text = 'a,b,c\n"He said ""hi"", ok",x\\,1\n"end \\","y ""z""",2\n plain , "spaced",3\n'
    (tmp_path / "q.csv").write_text(text)
    want = pd.read_csv(tmp_path / "q.csv", dtype=str)
    got = read_leads_csv(spark, str(tmp_path / "q.csv")).toPandas()
    assert got.iloc[:2].values.tolist() == want.iloc[:2].values.tolist()
    (tmp_path / "m.csv").write_text('a,b\n"two\nlines",1\n')
    assert read_leads_csv(spark, str(tmp_path / "m.csv"), multi_line=True).first()["a"] == "two\nlines"
