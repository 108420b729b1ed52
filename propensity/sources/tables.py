"""Scans of the driver tables and the deterministic views that stand in for the
pipeline's own tables (leads, events, raw lead CSV rows, a scored holdout).

All scans go through ``spark.read.parquet`` so projections and filters written
downstream reach the Parquet reader (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.constants import FORM_NAMES, PAGE_NAMES
from propensity.sources import files

# Reference instant of the fixture data ("now" of every as-of computation).
FIXTURE_NOW = "2024-01-25 00:00:00"
FIXTURE_EPOCH = "2024-01-01 00:00:00"

# Fixture mapping of the driver's raw event types onto the pipeline's five types.
RAW_EVENT_TYPE_MAP = (
    ("view", "page_view"),
    ("signup", "email_open"),
    ("click", "email_click"),
    ("purchase", "form_submission"),
    ("error", "email_unsubscribe"),
)
CONVERSION_MIN_VALUE = 150.0


def ntz(ts: str) -> Column:
    """A ``timestamp_ntz`` literal (driver tables are NTZ; keep arithmetic in NTZ)."""
    return F.lit(ts).cast("timestamp_ntz")


_TABLES: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame, resolved once per session (file listing and schema
    inference happen on first use, like registering a table in the catalog).
    Call ``refresh_tables`` after the files change."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _TABLES.get(key)
    if df is None:
        df = spark.read.parquet(path)
        _TABLES[key] = df
    return df


def refresh_tables() -> None:
    _TABLES.clear()


def _pick(values: tuple, index: Column) -> Column:
    """``values[index]`` for a 0-based integer Column (NULL index -> NULL)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behavioural events: lead_id, event_type, event_name, properties (JSON), occurred_at.

    ``properties`` carries ``session_id`` for sessionised page views, like the
    pipeline's JSON column; ``session_id`` is also exposed as a column.
    """
    raw = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    etype = None
    for src, dst in RAW_EVENT_TYPE_MAP:
        cond = F.col("event_type") == src
        etype = F.when(cond, F.lit(dst)) if etype is None else etype.when(cond, F.lit(dst))
    is_pv = F.col("event_type") == "view"
    name = (F.when(is_pv, _pick(PAGE_NAMES, F.pmod(k, F.lit(8))))
            .when(F.col("event_type") == "purchase", _pick(FORM_NAMES, F.pmod(k, F.lit(3)))))
    session = F.when(is_pv & (F.pmod(k, F.lit(10)) != 0),
                     F.concat(F.lit("s-"), F.date_format("ts", "yyyyMMdd")))
    props = F.to_json(F.struct(k.alias("k"), session.alias("session_id")))
    return raw.select(
        F.col("event_id"),
        F.col("user_id").alias("lead_id"),
        etype.alias("event_type"),
        name.alias("event_name"),
        props.alias("properties"),
        session.alias("session_id"),
        F.col("ts").alias("occurred_at"),
        F.col("value"),
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest qualifying purchase per user (partial aggregation before the shuffle)."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.where((F.col("event_type") == "purchase") & (F.col("value") >= CONVERSION_MIN_VALUE))
            .groupBy(F.col("user_id").alias("lead_id"))
            .agg(F.min("ts").alias("converted_at")))


def leads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads: lead_id, external_id, source_system, lead_source, total_time_spent,
    converted (NULL = unknown), converted_at, created_at."""
    cust = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    base = cust.select(
        key.alias("lead_id"),
        F.col("c_name").alias("external_id"),
        F.lit("kaggle").alias("source_system"),
        F.col("c_mktsegment").alias("lead_source"),
        F.col("c_acctbal").alias("total_time_spent"),
        F.timestamp_add("DAY", -F.pmod(key, F.lit(100)), ntz(FIXTURE_EPOCH)).alias("created_at"),
    )
    out = base.join(conversions(spark, sf_dir), "lead_id", "left")
    converted = F.when(F.pmod(F.col("lead_id"), F.lit(7)) == 6, F.lit(None).cast("boolean")) \
        .otherwise(F.col("converted_at").isNotNull())
    return out.select("lead_id", "external_id", "source_system", "lead_source", "total_time_spent",
                      converted.alias("converted"), "converted_at", "created_at")


# Value lists used to derive the raw (dirty) lead CSV rows from ``customer``.
_ORIGINS = ("API", "Landing Page Submission", "Lead Add Form", "Lead Import", "Quick Add Form")
_ACTIVITIES = ("Email Opened", "SMS Sent", "Page Visited on Website", "Olark Chat Conversation",
               "Converted to Lead", "Select")
_COUNTRIES = ("India", "United States", " India ", "Select")
_SPECIALIZATIONS = ("Finance Management", "Human Resource Management", "Marketing Management",
                    "Select", "select", "   ", "Specialization")
_OCCUPATIONS = ("Unemployed", "Working Professional", "Student", "Select")
_CITIES = ("Mumbai", "Thane & Outskirts", "\tMumbai\t", "Select", "Other Cities")
_TAGS = ("Will revert after reading the email", "Ringing", "Interested in other courses", None)


def raw_leads_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lead CSV rows (every column a string, CSV header names) derived from
    ``customer``; rows are in ``Lead Number`` order, which is the input order.

    Exercises every cleaning rule: blank / padded / ``Select`` placeholders,
    Yes/No/other booleans, 1/0/99/text labels, unparseable numerics, blank and
    repeated ids, an unmapped column.
    """
    cust = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m = lambda n: F.pmod(k, F.lit(n))
    name_of = lambda e: F.concat(F.lit("Customer#"), F.lpad(e.cast("string"), 9, "0"))
    seg = F.col("c_mktsegment")
    pid = (F.when(m(50) == 0, F.lit("")).when(m(50) == 1, F.lit("   ")).when(m(50) == 2, F.lit(None))
           .when(m(25) == 3, name_of(k - 3)).when(m(50) == 4, F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")))
           .otherwise(F.col("c_name")))
    source = (F.when(m(11) == 0, F.lit("select")).when(m(11) == 1, F.concat(F.lit(" "), seg, F.lit(" ")))
              .when(m(11) == 2, F.lit(None)).when(m(11) == 3, F.lit("")).otherwise(seg))
    email = _pick(("Yes", "No", "maybe", None, "No"), m(5))
    call = F.when(m(9) == 0, F.lit("Yes")).when(m(9) == 1, F.lit("nah")).otherwise(F.lit("No"))
    conv = (F.when(m(13) == 0, F.lit("99")).when(m(13) == 1, F.lit("abc")).when(m(13) == 2, F.lit(None))
            .when(m(13) == 3, F.lit("1.0")).when(m(13) == 4, F.lit("0.0"))
            .when(F.col("c_acctbal") > 5000, F.lit("1")).otherwise(F.lit("0")))
    visits = (F.when(m(8) == 0, F.lit("abc")).when(m(8) == 1, F.lit("5d")).when(m(8) == 2, F.lit(""))
              .when(m(8) == 3, F.lit(None)).when(m(8) == 4, F.lit(" 7 ")).when(m(8) == 5, F.lit("1e1"))
              .otherwise(F.pmod(k * 7, F.lit(30)).cast("string")))
    spent = F.when(m(10) == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    ppv = F.when(m(12) == 5, F.lit("")).otherwise((m(37) / F.lit(4.0)).cast("string"))
    return cust.select(
        pid.alias("Prospect ID"),
        F.concat(F.lit("LN"), (k + 100000).cast("string")).alias("Lead Number"),
        _pick(_ORIGINS, F.pmod(F.col("c_nationkey"), F.lit(5))).alias("Lead Origin"),
        source.alias("Lead Source"),
        email.alias("Do Not Email"),
        call.alias("Do Not Call"),
        conv.alias("Converted"),
        visits.alias("TotalVisits"),
        spent.alias("Total Time Spent on Website"),
        ppv.alias("Page Views Per Visit"),
        _pick(_ACTIVITIES, F.pmod(F.floor(k / 3), F.lit(6))).alias("Last Activity"),
        _pick(_COUNTRIES, F.pmod(F.col("c_nationkey"), F.lit(4))).alias("Country"),
        _pick(_SPECIALIZATIONS, m(7)).alias("Specialization"),
        _pick(_OCCUPATIONS, F.pmod(F.floor(k / 2), F.lit(4))).alias("What is your current occupation"),
        _pick(_CITIES, m(5)).alias("City"),
        _pick(_TAGS, F.pmod(F.floor(k / 5), F.lit(4))).alias("Tags"),
        k.alias("input_order"),
    )


def scored_holdout_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome ``y`` (labels.quality) with a deterministic probability ``p`` in (0, 1)."""
    lab = read_table(spark, sf_dir, "labels")
    p = (F.pmod(F.col("doc_id") * 37, F.lit(101)) + F.lit(0.5)) / F.lit(101.0)
    return lab.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), p.alias("p"))


def score_requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested lead ids with their request position (some ids are unknown,
    some requested twice): ``labels`` ids doubled, toxic ones repeated."""
    lab = read_table(spark, sf_dir, "labels")
    first = lab.select((F.col("doc_id") * 2).alias("lead_id"), F.col("doc_id").alias("position"))
    again = lab.where(F.col("toxic") == 1).select((F.col("doc_id") * 2).alias("lead_id"),
                                                  (-F.col("doc_id") - 1).alias("position"))
    return first.unionByName(again)


_REJECT = "_rejected_line"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder, from the first line of its first file, read on the
    driver without a job.  An empty name becomes its position, a repeated one gets it as a suffix."""
    line = files.first_line(spark, path)
    if line is None:
        raise ValueError(f"no CSV file with a header under {path}")
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]))):
        name = name or f"_c{i}"
        out.append(f"{name}{i}" if name.lower() in {n.lower() for n in out} else name)
    return out


def scan_leads_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` of a raw lead CSV with a header.

    ``rows``: every column a string (no inference), padding kept, the reader's missing-value
    tokens turned into NULL; a quote inside a quoted field is doubled, and a backslash is an
    ordinary character.  ``rejected``: one row ``line`` for each record with more or fewer fields
    than the header; none is cut or filled up.  Both come from the same scan with an explicit
    schema; the header costs no job.

    ``multi_line`` reads fields that hold line breaks; a file is then one task, so it
    is off unless asked for."""
    from propensity.operators.cleaning import na_tokens_to_null
    header = csv_header(spark, path)
    reject = _REJECT
    while reject in header:
        reject += "_"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, reject]])
    raw = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", reject)
           .option("columnPruning", False)  # a record's fields are counted, whatever columns are read
           .option("escape", '"').option("multiLine", multi_line).csv(path))
    # always true: Spark reads no CSV for its reject column alone, so a count has to name another one
    first = F.col(f"`{header[0]}`")
    raw = raw.where(first.isNull() | (F.length(first) >= 0))
    rows = na_tokens_to_null(raw.where(F.col(f"`{reject}`").isNull()).drop(reject))
    rejected = raw.where(F.col(f"`{reject}`").isNotNull()).select(F.col(f"`{reject}`").alias("line"))
    return rows, rejected


def read_leads_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The rows of :func:`scan_leads_csv`, without the rejected ones."""
    return scan_leads_csv(spark, path, multi_line)[0]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, padding preserved (the writer trims by default)."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


# Fixture lists for the CRM contact view (raw sizes include unmapped values).
_RAW_SIZES = ("1", "7", "10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000",
              "10000+", "unknown", " 11-50 ", "12", "")
_INDUSTRIES = ("Technology", "Software", "SaaS", "Retail", "Financial Services", "Healthcare", "Internet")
_TITLES = ("CEO", "VP Sales", "Engineer", "Head of Growth", "Analyst", "Director of IT", "Chief of Staff",
           "Manager", "vice president, marketing")


def crm_contacts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM contacts (lead_id, company_size, industry, job_title) derived from ``customer``."""
    cust = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return cust.select(k.alias("lead_id"),
                       _pick(_RAW_SIZES, F.pmod(k, F.lit(len(_RAW_SIZES)))).alias("company_size"),
                       _pick(_INDUSTRIES, F.pmod(F.col("c_nationkey"), F.lit(len(_INDUSTRIES)))).alias("industry"),
                       _pick(_TITLES, F.pmod(F.floor(k / 2), F.lit(len(_TITLES)))).alias("job_title"))


def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model registry derived from ``supplier``: one version per supplier (every
    sixth malformed), the version of supplier 7 active."""
    sup = read_table(spark, sf_dir, "supplier")
    k, r = F.col("s_suppkey"), F.pmod(F.col("s_nationkey"), F.lit(5))
    base = F.concat(F.lit("v"), (r + 1).cast("string"), F.lit("."), k.cast("string"))
    version = F.when(F.pmod(k, F.lit(6)) == 5, F.concat(base, F.lit(".1"))).otherwise(base)
    return sup.select(
        version.alias("version"),
        F.concat(F.lit("models/"), version).alias("artifact_path"),
        F.create_map(F.lit("auc_roc"), (F.lit(0.5) + F.pmod(k, F.lit(50)) / F.lit(100.0))).alias("metrics"),
        F.lit('{"max_depth": 6}').alias("hyperparameters"),
        F.array(F.lit("days_since_last_visit"), F.lit("total_sessions")).alias("feature_columns"),
        (k == 7).alias("is_active"),
        F.timestamp_add("DAY", k, ntz(FIXTURE_EPOCH)).alias("trained_at"),
    )


def predictions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged predictions derived from the scored holdout: (lead_id, score, bucket, model_version)."""
    from propensity.functions.scoring import score_bucket
    ho = scored_holdout_view(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return ho.join(lab, "id").select(
        F.col("id").alias("lead_id"), F.col("p").alias("score"), score_bucket("p").alias("bucket"),
        F.when(F.col("toxic") == 1, F.lit("v1.1")).otherwise(F.lit("v1.0")).alias("model_version"))


def prediction_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with several predictions per lead: those of ``predictions_view`` and a second scoring
    of every lead by v1.2, each with its time; some leads have both at the same time."""
    from propensity.functions.scoring import score_bucket
    now = ntz(FIXTURE_NOW)
    hours = lambda n: F.timestamp_add("HOUR", -F.pmod(n, F.lit(30)), now)
    first = predictions_view(spark, sf_dir).withColumn("scored_at", hours(F.col("lead_id")))
    again = first.select("lead_id", (1 - F.col("score")).alias("score")).select(
        "lead_id", "score", score_bucket("score").alias("bucket"), F.lit("v1.2").alias("model_version"),
        hours(F.col("lead_id") * 7).alias("scored_at"))
    return first.unionByName(again)


def append_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append-only sink: events or predictions join what the folder holds."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def adhoc_sql(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Run a SQL string over the given frames registered as temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
