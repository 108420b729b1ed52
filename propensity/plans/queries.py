"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their SQL oracles.

Every query reads the driver tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.catalogue import default_catalogue, with_builder
from propensity.constants import BOOLEAN_FEATURES, CSV_COLUMN_MAP, MODEL_FEATURES, NUMERIC_CSV_COLUMNS
from propensity.functions import checked as ck
from propensity.functions import json as fj
from propensity.functions import rules as ru
from propensity.functions import scoring as fs
from propensity.operators import constraints as cs
from propensity.operators import profile as pf
from propensity.operators import registry as rg
from propensity.operators import cleaning as cl
from propensity.session import checkpoint, scratch_path
from propensity.operators import dataset as ds
from propensity.operators import features as feat
from propensity.operators import joins as jn
from propensity.operators import metrics as mt
from propensity.operators import model as md
from propensity.operators import scoring as sc
from propensity.operators import tuning as tn
from propensity.operators import windows as wn
from propensity.plans import oracle as O
from propensity.sources import files
from propensity.sources import prediction_log as pl
from propensity.sources import tables as tb
from propensity.streaming import score_stream as ss
from propensity.streaming import throttle as th

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"a query named {name} is there already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# FA: feature matrix at one shared cut-off ("now")
# ---------------------------------------------------------------------------

@register("feature_matrix", O.with_(O.EV, O.LEADS,
                                    f"pit AS (SELECT *, {O.NOW} AS as_of FROM ev WHERE occurred_at < {O.NOW})",
                                    O.FEATURE_AGG) + f"""
SELECT l.lead_id, {O.NOW} AS as_of, {O.FEATURE_COLUMNS}
FROM leads l LEFT JOIN agg ON agg.lead_id = l.lead_id LEFT JOIN sagg ON sagg.lead_id = l.lead_id""")
def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir)
    events = tb.events_view(spark, sf_dir)
    return feat.feature_matrix(leads, events, as_of=tb.FIXTURE_NOW)


def _fm_now_sql(select_cols: str) -> str:
    return O.with_(O.EV, O.LEADS, f"pit AS (SELECT *, {O.NOW} AS as_of FROM ev WHERE occurred_at < {O.NOW})",
                   O.FEATURE_AGG, f"""fm AS (
  SELECT l.lead_id, {O.NOW} AS as_of, {O.FEATURE_COLUMNS}
  FROM leads l LEFT JOIN agg ON agg.lead_id = l.lead_id LEFT JOIN sagg ON sagg.lead_id = l.lead_id)""") + \
        f"SELECT {select_cols} FROM fm"


# F1-F20: each catalogue feature on its own (Catalyst prunes the other aggregates).
def _feature_query(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q_feature_matrix(spark, sf_dir).select("lead_id", name)
    q.__name__ = f"q_{name}"
    return q


for _f in default_catalogue.names:
    register(_f, _fm_now_sql(f"lead_id, {_f}"))(_feature_query(_f))


# ---------------------------------------------------------------------------
# J2 / P1: point-in-time join with per-lead cut-offs; M1 training set with W1
# ---------------------------------------------------------------------------

def _labelled_with_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir)
    return ds.with_as_of(ds.labelled(leads), tb.events_view(spark, sf_dir), tb.FIXTURE_NOW)


@register("pit_join", O.with_(O.EV, O.LEADS, O.LABELLED) + """
SELECT ev.lead_id, ev.event_id, ev.event_type, ev.occurred_at, lab.as_of
FROM ev JOIN lab ON ev.lead_id = lab.lead_id AND ev.occurred_at < lab.as_of""")
def q_pit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _labelled_with_as_of(spark, sf_dir)
    ev = tb.events_view(spark, sf_dir).select("lead_id", "event_id", "event_type", "occurred_at")
    return feat.pit_join(lab, ev)


@register("as_of_date", O.with_(O.EV, O.LEADS, O.LABELLED) + "SELECT lead_id, as_of FROM lab")
def q_as_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_with_as_of(spark, sf_dir).select("lead_id", "as_of")


@register("training_dataset", O.with_(O.EV, O.LEADS, O.LABELLED,
                                      "pit AS (SELECT ev.*, lab.as_of FROM ev JOIN lab ON ev.lead_id = lab.lead_id "
                                      "AND ev.occurred_at < lab.as_of)", O.FEATURE_AGG, f"""fm AS (
  SELECT lab.lead_id, lab.as_of, lab.converted, {O.FEATURE_COLUMNS}
  FROM lab LEFT JOIN agg ON agg.lead_id = lab.lead_id LEFT JOIN sagg ON sagg.lead_id = lab.lead_id)""") + f"""
SELECT lead_id, as_of, {O.MODEL_FEATURE_LIST}, converted,
  CASE WHEN row_number() OVER (ORDER BY as_of, lead_id) <= floor(count(*) OVER () * 0.8)
       THEN 'train' ELSE 'test' END AS split
FROM fm""")
def q_training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir)
    events = tb.events_view(spark, sf_dir)
    return ds.labelled_features(leads, events, tb.FIXTURE_NOW, test_fraction=ds.TEST_FRACTION)


@register("labelled_leads", O.with_(O.EV, O.LEADS, O.LABELLED) + "SELECT lead_id, converted FROM lab")
def q_labelled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.labelled(tb.leads_view(spark, sf_dir)).select("lead_id", "converted")


@register("label_rate", O.with_(O.EV, O.LEADS, O.LABELLED) +
          "SELECT avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END) AS label_rate FROM lab")
def q_label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ds.label_rate(ds.labelled(tb.leads_view(spark, sf_dir)))


@register("label_rate_by_split", "SELECT split, avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END) AS label_rate FROM ("
          + ORACLE["training_dataset"] + ") t GROUP BY split")
def q_label_rate_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _labelled_with_as_of(spark, sf_dir).select("lead_id", "converted", "as_of")
    return ds.label_rate(ds.time_split(checkpoint(lab)), by="split")


# ---------------------------------------------------------------------------
# Joins J1, J3, J4, S3; aggregations A1, A2
# ---------------------------------------------------------------------------

@register("lead_latest_event", O.with_(O.EV, O.LEADS) + """
SELECT l.lead_id, m.latest_event_at FROM leads l
LEFT JOIN (SELECT lead_id, max(occurred_at) AS latest_event_at FROM ev GROUP BY lead_id) m ON m.lead_id = l.lead_id""")
def q_lead_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id")
    return jn.with_latest_event(leads, tb.events_view(spark, sf_dir))


@register("latest_event", O.with_(O.EV) +
          "SELECT lead_id, max(occurred_at) AS latest_event_at FROM ev GROUP BY lead_id")
def q_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.latest_event(tb.events_view(spark, sf_dir))


@register("leads_without_events", O.with_(O.EV, O.LEADS) + """
SELECT l.lead_id, l.external_id FROM leads l
LEFT JOIN (SELECT DISTINCT lead_id FROM ev) e ON e.lead_id = l.lead_id WHERE e.lead_id IS NULL""")
def q_leads_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id", "external_id")
    return jn.without_events(leads, tb.events_view(spark, sf_dir))


@register("missing_ids", O.with_(O.REQUESTS) + """
SELECT r.lead_id, r.position FROM req r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.lead_id)""")
def q_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir)
    return jn.missing_ids(tb.score_requests_view(spark, sf_dir), leads)


@register("lookup_leads_by_ids", O.with_(O.EV, O.LEADS, O.REQUESTS) + """
SELECT l.lead_id, l.external_id FROM leads l WHERE l.lead_id IN (SELECT lead_id FROM req)""")
def q_lookup_leads_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id", "external_id")
    return jn.lookup_by_ids(leads, tb.score_requests_view(spark, sf_dir))


@register("session_rollup", O.with_(O.EV) + f"""
SELECT lead_id, session_id, count(*) AS page_views,
       (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 1e6 AS duration_seconds
FROM ev WHERE occurred_at < {O.NOW} AND event_type = 'page_view' AND session_id IS NOT NULL
GROUP BY lead_id, session_id""")
def q_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = feat.pit_filter(tb.events_view(spark, sf_dir), tb.FIXTURE_NOW)
    return feat.session_rollup(ev)


# ---------------------------------------------------------------------------
# Windows W4, W6
# ---------------------------------------------------------------------------

@register("sessionize_6h", O.with_(O.EV) + """, f AS (
  SELECT *, CASE WHEN event_type = 'page_view' AND NOT coalesce(
      lag(event_type) OVER w = 'page_view'
      AND epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER w) <= 21600000000, false) THEN 1 ELSE 0 END AS st
  FROM ev WINDOW w AS (PARTITION BY lead_id ORDER BY occurred_at, event_id)
)
SELECT event_id, lead_id, event_type, occurred_at,
  CASE WHEN event_type = 'page_view' THEN CAST(sum(st) OVER (PARTITION BY lead_id ORDER BY occurred_at, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS session_no
FROM f""")
def q_sessionize_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir).select("event_id", "lead_id", "event_type", "occurred_at")
    return wn.sessionize(ev, gap_seconds=6 * 3600)


@register("latest_event_per_lead", O.with_(O.EV) + """
SELECT lead_id, event_id, event_type, occurred_at FROM (
  SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at DESC, event_id DESC) AS rn FROM ev) x
WHERE rn = 1""")
def q_latest_event_per_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir).select("lead_id", "event_id", "event_type", "occurred_at")
    return wn.latest_per_key(ev, "lead_id", "occurred_at", tie="event_id")


# ---------------------------------------------------------------------------
# Cleaning C1-C10, load S1/S4, summaries A3/A4
# ---------------------------------------------------------------------------

def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.na_tokens_to_null(tb.raw_leads_view(spark, sf_dir), exclude=("input_order",))


_C = O.with_(O.clean_ctes())
_SOME = ("City", "Lead Source", "Specialization", "Country")


def _snake(c: str) -> str:
    return dict(CSV_COLUMN_MAP)[c]


@register("scan_csv_leads")
def q_scan_csv_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "raw_leads_csv/" + sf_dir.strip("/").replace("/", "_"))
    tb.write_csv(tb.raw_leads_view(spark, sf_dir), path)
    df = tb.read_leads_csv(spark, path)
    return df.select(F.col("input_order").cast("bigint").alias("input_order"),
                     *[F.col(f"`{c}`").alias(_snake(c)) for c, _ in CSV_COLUMN_MAP])


ORACLE["scan_csv_leads"] = _C + "SELECT input_order, " + ", ".join(
    f'{O.q(c)} AS {d}' for c, d in CSV_COLUMN_MAP) + " FROM na"


@register("scan_csv_rejects", """SELECT count(*) FILTER (WHERE kind = 0) AS n_rows, count(*) FILTER (WHERE kind = 1) AS n_long,
  count(*) FILTER (WHERE kind = 2) AS n_short, sum(c_custkey) FILTER (WHERE kind = 0)::BIGINT AS sum_keys
FROM (SELECT c_custkey, CASE WHEN c_custkey % 17 = 3 THEN 1 WHEN c_custkey % 17 = 9 THEN 2 ELSE 0 END AS kind FROM customer)""")
def q_scan_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # customers as CSV lines, some with a field too many, some with one too few
    import uuid
    k = F.col("c_custkey")
    fields = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), "c_name", F.lit('"')), F.col("c_acctbal").cast("string"))
    line = F.when(k % 17 == 3, F.concat(fields, F.lit(",x"))).when(k % 17 == 9, F.concat_ws(",", k.cast("string"), "c_name")).otherwise(fields)
    path = scratch_path(spark, f"rejects_csv/{uuid.uuid4().hex}")
    # one column per line, unquoted, with a header in each file, as an exporter writes them
    (tb.read_table(spark, sf_dir, "customer").select(line.alias("Lead Number,Name,Balance")).write.option("header", True)
     .option("sep", "\t").option("quote", "").option("escape", "").csv(path))
    rows, rejected = tb.scan_leads_csv(spark, path)
    long_ = F.size(F.split("line", ",")) > 3
    tagged = rows.select(F.lit(0).alias("kind"), F.col("`Lead Number`").cast("bigint").alias("key")).unionByName(
        rejected.select(F.when(long_, 1).otherwise(2).alias("kind"), F.lit(None).cast("bigint").alias("key")))
    return tagged.agg(*[F.count_if(F.col("kind") == i).alias(n) for i, n in enumerate(("n_rows", "n_long", "n_short"))],
                      F.sum("key").alias("sum_keys"))


@register("strip_strings", _C + "SELECT input_order, " + ", ".join(f"{O.q(c)} AS {_snake(c)}" for c in _SOME) +
          " FROM st")
def q_strip_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.strip_strings(_raw(spark, sf_dir))
    return df.select("input_order", *[F.col(f"`{c}`").alias(_snake(c)) for c in _SOME])


@register("replace_placeholders", _C + "SELECT input_order, " + ", ".join(f"{O.q(c)} AS {_snake(c)}" for c in _SOME) +
          " FROM ph")
def q_replace_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.replace_placeholders(_raw(spark, sf_dir))
    return df.select("input_order", *[F.col(f"`{c}`").alias(_snake(c)) for c in _SOME])


@register("yes_no_to_bool", _C + "SELECT input_order, do_not_email, do_not_call FROM cleaned")
def q_yes_no_to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.convert_booleans(cl.replace_placeholders(_raw(spark, sf_dir)))
    return df.select("input_order", F.col("`Do Not Email`").alias("do_not_email"),
                     F.col("`Do Not Call`").alias("do_not_call"))


@register("flag_to_nullable_bool", _C + "SELECT input_order, converted FROM cleaned")
def q_flag_to_nullable_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.convert_booleans(cl.replace_placeholders(_raw(spark, sf_dir)))
    return df.select("input_order", F.col("Converted").alias("converted"))


@register("coerce_numerics", _C + "SELECT input_order, total_visits, total_time_spent, page_views_per_visit FROM cleaned")
def q_coerce_numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cl.coerce_numerics(cl.replace_placeholders(_raw(spark, sf_dir)))
    return df.select("input_order", *[F.col(f"`{c}`").alias(_snake(c)) for c in NUMERIC_CSV_COLUMNS])


@register("rename_and_project", _C + "SELECT " + ", ".join(f"{O.q(c)} AS {d}" for c, d in CSV_COLUMN_MAP) +
          ", input_order FROM na")
def q_rename_and_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.rename_columns(_raw(spark, sf_dir), keep=["input_order"])


@register("clean_leads", _C + "SELECT * FROM cleaned")
def q_clean_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.clean_leads(_raw(spark, sf_dir))


@register("validate_required", _C + """SELECT input_order, true AS is_valid FROM valid
UNION ALL SELECT input_order, false AS is_valid FROM rejected""")
def q_validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = cl.split_required(cl.clean_leads(_raw(spark, sf_dir)))
    return (valid.select("input_order", F.lit(True).alias("is_valid"))
            .unionByName(rejected.select("input_order", F.lit(False).alias("is_valid"))))


@register("valid_leads", _C + "SELECT * EXCLUDE (source_system), source_system FROM valid")
def q_valid_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    return valid


@register("append_ignore_existing", _C + "SELECT external_id, input_order FROM inserted")
def q_append_ignore_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    return cl.rows_to_insert(None, valid).select("external_id", "input_order")


_SUMMARY = """SELECT (SELECT count(*) FROM raw) AS total_read,
  (SELECT count(*) FROM rejected) AS total_rejected,
  (SELECT count(*) FROM valid) - {ins} AS total_skipped,
  {ins} AS total_inserted,
  CASE WHEN (SELECT count(*) FROM valid) > 0 THEN round_even(
    (SELECT count(*) FILTER (WHERE converted) FROM valid) / (SELECT count(*) FROM valid) * 100.0, 1)
    ELSE 0.0 END AS conversion_rate"""


@register("load_summary", _C + _SUMMARY.format(ins="(SELECT count(*) FROM inserted)"))
def q_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.load_summary(tb.raw_leads_view(spark, sf_dir))


@register("reload_summary", _C + _SUMMARY.format(ins="CAST(0 AS BIGINT)"))
def q_reload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tb.raw_leads_view(spark, sf_dir)
    return cl.load_summary(raw, cl.rows_to_insert(None, cl.prepare_load(raw)[0]))


def _null_pct_sql(cols: list[str], src: str) -> str:
    parts = [f"SELECT '{c}' AS column_name, CASE WHEN count(*) > 0 THEN round_even("
             f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100.0, 1) ELSE 0.0 END AS null_pct FROM {src}"
             for c in cols]
    return "\nUNION ALL ".join(parts)


@register("null_percentages", _C + _null_pct_sql([d for _, d in CSV_COLUMN_MAP], "valid"))
def q_null_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    return cl.null_percentages(valid.drop("input_order"))


# ---------------------------------------------------------------------------
# Metrics M4-M7 on the scored holdout view
# ---------------------------------------------------------------------------

def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.scored_holdout_view(spark, sf_dir)


@register("metric_auc_roc", O.with_(O.HOLDOUT, """g AS (
  SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM ho GROUP BY p),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)""") + """
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc_roc FROM c""")
def q_metric_auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auc_roc(_holdout(spark, sf_dir))


@register("metric_auc_roc_continuous", """WITH ho AS (
  SELECT l_extendedprice * (1 - l_discount) AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), g AS (
  SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM ho GROUP BY p),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc_roc FROM c""")
def q_metric_auc_roc_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tb.read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    return mt.auc_roc(items)


@register("metric_precision_recall_f1", O.with_(O.HOLDOUT, """c AS (SELECT
  count(*) FILTER (WHERE p > 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p > 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE p <= 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p <= 0.5 AND y = 0) AS tn FROM ho)""") + """
SELECT tp, fp, fn, tn,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c""")
def q_metric_precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion_metrics(_holdout(spark, sf_dir))


@register("metric_log_loss", O.with_(O.HOLDOUT) + f"""
SELECT avg(-(y * ln(least(greatest(p, {mt.EPS!r}), 1 - {mt.EPS!r}))
         + (1 - y) * ln(1 - least(greatest(p, {mt.EPS!r}), 1 - {mt.EPS!r})))) AS log_loss FROM ho""")
def q_metric_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.log_loss(_holdout(spark, sf_dir))


@register("calibration_error", O.with_(O.HOLDOUT, """q AS (
  SELECT quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM ho),
edges AS (SELECT i, CASE WHEN i = 0 THEN 0.0 ELSE e[i + 1] END AS lo,
                    CASE WHEN i = 9 THEN 1.00000001 ELSE e[i + 2] END AS hi
          FROM q, range(10) t(i)),
b AS (SELECT edges.i, count(*) AS n, avg(y) AS acc, avg(p) AS conf
      FROM ho JOIN edges ON ho.p >= edges.lo AND ho.p < edges.hi GROUP BY edges.i)""") + """
SELECT coalesce(sum(n * abs(acc - conf)), 0.0) / (SELECT count(*) FROM ho) AS calibration_error FROM b""")
def q_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.calibration_error(_holdout(spark, sf_dir))


# ---------------------------------------------------------------------------
# Profiling A5-A9, E1-E5, W3, P5 over the loaded leads; A6 over events
# ---------------------------------------------------------------------------

def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    return cl.rows_to_insert(None, valid)


_NUMS = ["total_visits", "total_time_spent", "page_views_per_visit"]
_CATS = ["lead_origin", "lead_source", "country", "current_occupation", "specialization", "last_activity"]
_LEAD_COLS = [d for _, d in CSV_COLUMN_MAP] + ["source_system"]


@register("count_by_source", _C + "SELECT source_system, count(*) AS count FROM inserted GROUP BY source_system")
def q_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.count_by(_loaded(spark, sf_dir), "source_system")


@register("null_percentages_sql", _C + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_pct "
    f"FROM inserted" for c in _LEAD_COLS))
def q_null_percentages_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.null_percentages_long(_loaded(spark, sf_dir), _LEAD_COLS)


@register("any_not_null", _C + "SELECT external_id, " + ", ".join(_NUMS) + " FROM inserted WHERE " +
          " OR ".join(f"{c} IS NOT NULL" for c in _NUMS))
def q_any_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.any_not_null(_loaded(spark, sf_dir), _NUMS).select("external_id", *_NUMS)


_HIST_SQL = _C + """, nn AS (SELECT * FROM inserted WHERE total_visits IS NOT NULL OR total_time_spent IS NOT NULL
                              OR page_views_per_visit IS NOT NULL),
hs AS (""" + "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM nn WHERE {c} IS NOT NULL"
                                 for c in _NUMS) + """),
mm AS (SELECT column_name, min(v) AS mn, max(v) AS mx FROM hs GROUP BY column_name),
lh AS (SELECT column_name, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
              CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM mm),
b AS (SELECT hs.column_name, least(CAST(floor((v - lo) / (hi - lo) * 40.0) AS INTEGER), 39) AS bin
      FROM hs JOIN lh USING (column_name)),
c AS (SELECT column_name, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT column_name, lo, hi, CAST(bin AS INTEGER) AS bin FROM lh, range(40) t(bin))
SELECT g.column_name, g.bin, g.lo + g.bin * ((g.hi - g.lo) / 40.0) AS bin_lo,
       g.lo + (g.bin + 1) * ((g.hi - g.lo) / 40.0) AS bin_hi, coalesce(c.n, 0) AS count
FROM g LEFT JOIN c ON c.column_name = g.column_name AND c.bin = g.bin"""


@register("numeric_histogram", _HIST_SQL)
def q_numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.histogram(pf.any_not_null(_loaded(spark, sf_dir), _NUMS), _NUMS, bins=40)


@register("top_values", _C + ", tv AS (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS count FROM inserted WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _CATS) + """)
SELECT column_name, value, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value ASC) AS rank FROM tv) x
WHERE rank <= 10""")
def q_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.top_values(_loaded(spark, sf_dir), _CATS, k=10)


@register("conversion_overall", _C + """SELECT count(*) AS total,
  count(*) FILTER (WHERE converted) AS converted_count,
  round(100.0 * count(*) FILTER (WHERE converted) / count(*), 2) AS conversion_rate_pct FROM inserted""")
def q_conversion_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.conversion_overall(_loaded(spark, sf_dir))


def _conv_by_sql(col: str) -> str:
    return _C + f"""SELECT {col}, round(100.0 * count(*) FILTER (WHERE converted) / count(*), 2) AS conversion_rate_pct,
  count(*) AS total FROM inserted WHERE {col} IS NOT NULL GROUP BY {col}
ORDER BY conversion_rate_pct DESC, {col} ASC LIMIT 15"""


@register("conversion_by_source", _conv_by_sql("lead_source"))
def q_conversion_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.conversion_by(_loaded(spark, sf_dir), "lead_source", k=15)


@register("conversion_by_activity", _conv_by_sql("last_activity"))
def q_conversion_by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.conversion_by(_loaded(spark, sf_dir), "last_activity", k=15)


_CORR_VARS = _NUMS + ["converted"]


def _corr_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_CORR_VARS) for b in _CORR_VARS[i + 1:]]
    rows = []
    for a, b in pairs:
        rows.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, corr({a}, {b}) AS corr FROM cm")
        rows.append(f"SELECT '{b}' AS var_a, '{a}' AS var_b, corr({a}, {b}) AS corr FROM cm")
    for c in _CORR_VARS:
        rows.append(f"SELECT '{c}' AS var_a, '{c}' AS var_b, CASE WHEN stddev_samp({c}) > 0 THEN 1.0 END AS corr FROM cm")
    return (_C + ", cm AS (SELECT total_visits, total_time_spent, page_views_per_visit, "
            "CASE WHEN converted THEN 1 ELSE 0 END AS converted FROM inserted)\n" + "\nUNION ALL ".join(rows))


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _loaded(spark, sf_dir).select(*_NUMS, F.when(F.col("converted"), 1).otherwise(0).alias("converted"))
    return pf.correlation_matrix(df, _CORR_VARS)


@register("events_by_type", O.with_(O.EV) + """, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY event_type),
t AS (SELECT unnest(['page_view', 'email_open', 'email_click', 'form_submission', 'email_unsubscribe']) AS event_type)
SELECT t.event_type, coalesce(c.n, 0) AS count,
  CASE WHEN sum(coalesce(c.n, 0)) OVER () > 0 THEN coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER () * 100.0
       ELSE 0.0 END AS pct
FROM t LEFT JOIN c USING (event_type)""")
def q_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.events_by_type(tb.events_view(spark, sf_dir))


@register("class_balance", O.with_(O.EV, O.LEADS, O.LABELLED) + """SELECT
  count(*) FILTER (WHERE NOT converted) AS n_neg, count(*) FILTER (WHERE converted) AS n_pos,
  CASE WHEN count(*) FILTER (WHERE converted) > 0
       THEN count(*) FILTER (WHERE NOT converted) / count(*) FILTER (WHERE converted) END AS pos_weight FROM lab""")
def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.class_balance(ds.labelled(tb.leads_view(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Registry A10, A11, M11, M12, P6
# ---------------------------------------------------------------------------

@register("existing_versions", O.with_(O.REGISTRY) + "SELECT version FROM reg")
def q_existing_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.registry_view(spark, sf_dir).select("version")


@register("next_version", O.with_(O.REGISTRY) + """, p AS (
  SELECT string_split(ltrim(version, 'v'), '.') AS parts FROM reg),
ok AS (SELECT CAST(parts[1] AS INTEGER) AS major, CAST(parts[2] AS INTEGER) AS minor FROM p WHERE len(parts) = 2),
best AS (SELECT major, minor FROM (SELECT major, minor FROM ok UNION ALL SELECT 1, -1)
         ORDER BY major DESC, minor DESC LIMIT 1)
SELECT 'v' || CAST(major AS VARCHAR) || '.' || CAST(minor + 1 AS VARCHAR) AS next_version FROM best""")
def q_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.next_version(tb.registry_view(spark, sf_dir))


@register("active_only", O.with_(O.REGISTRY) + "SELECT version FROM reg WHERE is_active")
def q_active_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.active(tb.registry_view(spark, sf_dir)).select("version")


@register("active_model_info", O.with_(O.REGISTRY) + """SELECT version, 0.5 + (s_suppkey % 50) / 100.0 AS auc_roc,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(s_suppkey AS INTEGER)) AS trained_at FROM reg WHERE is_active""")
def q_active_model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = rg.active_model_info(tb.registry_view(spark, sf_dir))
    return info.select("version", F.col("metrics")["auc_roc"].alias("auc_roc"), "trained_at")


@register("register_model", O.with_(O.REGISTRY) + """SELECT version, false AS is_active FROM reg
UNION ALL SELECT 'v9.9' AS version, true AS is_active""")
def q_register_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = rg.register_model(tb.registry_view(spark, sf_dir), "v9.9", "models/v9.9", {"auc_roc": 0.9},
                            {"max_depth": 6}, ["days_since_last_visit"], set_active=True)
    return reg.select("version", "is_active")


@register("registry_commits", O.with_(O.REGISTRY) + """SELECT version, false AS is_active, CAST(2 AS BIGINT) AS commits, true AS refused
FROM reg UNION ALL SELECT 'v9.9', true, 2, true""")
def q_registry_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits (the suppliers' versions, then a new active one) and one refused: a version twice."""
    import uuid
    store = rg.RegistryStore(spark, scratch_path(spark, f"registry/{uuid.uuid4().hex}"))
    store.commit(lambda _: tb.registry_view(spark, sf_dir))
    store.register("v9.9", "models/v9.9", {"auc_roc": 0.9}, {"max_depth": 6}, ["days_since_last_visit"], set_active=True)
    try:
        store.register("v9.9", "models/other", {}, {}, [])
        refused = False
    except rg.DuplicateVersion:
        refused = True
    return store.read().select("version", "is_active", F.lit(len(store.commits())).cast("bigint").alias("commits"),
                               F.lit(refused).alias("refused"))


# ---------------------------------------------------------------------------
# Scoring helpers X4, X5, W2, K4, K5 (deterministic scores, no model needed)
# ---------------------------------------------------------------------------

@register("score_bucket", O.with_(O.PREDICTIONS) + "SELECT lead_id, score, bucket FROM pred")
def q_score_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    ho = tb.scored_holdout_view(spark, sf_dir)
    return ho.select(F.col("id").alias("lead_id"), F.col("p").alias("score"), fs.score_bucket("p").alias("bucket"))


@register("valid_score_row", O.with_(O.PREDICTIONS) + """SELECT lead_id,
  coalesce(score BETWEEN 0 AND 1 AND bucket IN ('A', 'B', 'C', 'D'), false) AS is_valid FROM pred""")
def q_valid_score_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.predictions_view(spark, sf_dir).select("lead_id", fs.valid_score().alias("is_valid"))


@register("prediction_log_query", O.with_(O.PREDICTIONS) +
          "SELECT model_version, bucket, count(*) AS count FROM pred GROUP BY model_version, bucket")
def q_prediction_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.predictions_view(spark, sf_dir).groupBy("model_version", "bucket").agg(F.count(F.lit(1)).alias("count"))


def _prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log, appended to in two batches."""
    import uuid
    name = uuid.uuid4().hex
    view = tb.prediction_log_view(spark, sf_dir)
    for batch in (view.where(F.col("model_version") != "v1.2"), view.where(F.col("model_version") == "v1.2")):
        pl.append(batch, f"prediction_log_{name}", scratch_path(spark, f"prediction_log/{name}"))
    return pl.read(spark, f"prediction_log_{name}")


@register("latest_prediction_per_lead", O.with_(O.PREDICTION_LOG) + """SELECT lead_id, score, bucket, scored_at, model_version FROM (
  SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY scored_at DESC, model_version DESC) AS rn FROM log) x WHERE rn = 1""")
def q_latest_prediction_per_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.latest_per_lead(_prediction_log(spark, sf_dir)).select(
        "lead_id", "score", "bucket", "scored_at", F.col("model_version").cast("string").alias("model_version"))


@register("prediction_counts_of_version", O.with_(O.PREDICTION_LOG) +
          "SELECT model_version, bucket, count(*) AS count FROM log WHERE model_version = 'v1.1' GROUP BY model_version, bucket")
def q_prediction_counts_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.counts(_prediction_log(spark, sf_dir), "v1.1")


# Stand-in global importances for the 17 model features (a rule, not a model).
FIXTURE_IMPORTANCES = [((i * 7) % 17 + 1) / 153.0 for i in range(len(MODEL_FEATURES))]


def _factors_sql() -> str:
    # importances are (i * 7 % 17 + 1) / 153: 17, 16, ... at i with i * 7 % 17 = 16, 15, ...
    rows = []
    for i, k in enumerate((12, 7, 2, 14, 9), start=1):
        nm, imp = MODEL_FEATURES[k], (18 - i) / 153.0
        val = (f"CASE WHEN {nm} THEN 'true' ELSE 'false' END" if nm in BOOLEAN_FEATURES
               else f"CAST({nm} AS VARCHAR)")
        rows.append(f"SELECT lead_id, {i} AS rank, '{nm}' AS feature, CAST({imp!r} AS DOUBLE) AS impact, "
                    f"{val} AS value FROM fm")
    return _fm_now_sql("*").replace("SELECT * FROM fm", "") + "\nUNION ALL ".join(rows)


@register("top_factors", _factors_sql())
def q_top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = q_feature_matrix(spark, sf_dir)
    arr = fs.top_factors(list(MODEL_FEATURES), FIXTURE_IMPORTANCES)
    return (fm.select("lead_id", F.posexplode(arr).alias("pos", "f"))
            .select("lead_id", (F.col("pos") + 1).alias("rank"), "f.feature", "f.impact", "f.value"))


@register("feature_snapshot", _fm_now_sql("lead_id, CAST(to_json(json_object(" + ", ".join(
    f"'{c}', {c}" for c in MODEL_FEATURES) + ")) AS VARCHAR) AS snapshot"))
def q_feature_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = q_feature_matrix(spark, sf_dir)
    return fm.select("lead_id", fs.feature_snapshot(list(MODEL_FEATURES)).alias("snapshot"))


# ---------------------------------------------------------------------------
# Constraints C11, defaults C12, validation V1/V2, CRM rules R1-R4
# ---------------------------------------------------------------------------

@register("constraint_violations", _C + """, d AS (SELECT external_id FROM valid GROUP BY external_id HAVING count(*) > 1)
SELECT input_order, 'unique:external_id' AS rule FROM valid WHERE external_id IN (SELECT external_id FROM d)
UNION ALL SELECT input_order, 'max_length:external_id' FROM valid WHERE length(external_id) > 50
UNION ALL SELECT input_order, 'max_length:tags' FROM valid WHERE length(tags) > 200""")
def q_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    v = cs.lead_violations(valid)
    return v.select("input_order", F.explode("violations").alias("rule"))


@register("event_constraint_violations", O.with_(O.EV) + """, bad AS (SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN -lead_id - 1 ELSE lead_id END AS lead_id,
  CASE WHEN event_id % 89 = 0 THEN 'phone_call' ELSE event_type END AS event_type FROM ev)
SELECT event_id, 'fk:lead_id' AS rule FROM bad
WHERE lead_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT event_id, 'check:event_type' FROM bad
WHERE event_type NOT IN ('page_view', 'email_open', 'email_click', 'form_submission', 'email_unsubscribe')""")
def q_event_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    # some events name a lead that isn't there, some a type that isn't allowed
    ev = (tb.events_view(spark, sf_dir)
          .withColumn("lead_id", F.when(F.col("event_id") % 97 == 0, -F.col("lead_id") - 1).otherwise(F.col("lead_id")))
          .withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "phone_call").otherwise(F.col("event_type"))))
    v = cs.event_violations(ev, tb.leads_view(spark, sf_dir).select("lead_id"))
    return v.select("event_id", F.explode("violations").alias("rule"))


_LEAD_RULES = {"lead": "lead_id"}


@register("prediction_constraint_violations", O.broken_rules(
    O.BAD_PREDICTIONS, "labels", ["lead_id", "score", "bucket", "model_version", "scored_at"], [("bucket", 10), ("model_version", 20)],
    {"bucket": ["A", "B", "C", "D"]}, **_LEAD_RULES))
def q_prediction_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.adhoc_sql(spark, f"SELECT {O.BAD_PREDICTIONS} FROM bad_labels", bad_labels=tb.read_table(spark, sf_dir, "labels"))
    v = cs.prediction_violations(rows, tb.leads_view(spark, sf_dir).select("lead_id"))
    return v.select("id", F.explode("violations").alias("rule"))


@register("sync_log_constraint_violations", O.broken_rules(
    O.BAD_SYNC_LOGS, "labels", ["lead_id", "source_system", "action", "status"],
    [("source_system", 20), ("external_id", 100), ("action", 50), ("status", 20)],
    {"status": ["success", "failed", "pending"]}, **_LEAD_RULES))
def q_sync_log_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.adhoc_sql(spark, f"SELECT {O.BAD_SYNC_LOGS} FROM bad_labels", bad_labels=tb.read_table(spark, sf_dir, "labels"))
    v = cs.sync_log_violations(rows, tb.leads_view(spark, sf_dir).select("lead_id"))
    return v.select("id", F.explode("violations").alias("rule"))


@register("registry_constraint_violations", O.broken_rules(
    O.BAD_REGISTRY, "supplier", ["version", "artifact_path", "trained_at"], [("version", 20), ("artifact_path", 500)], {},
    unique=["version"]))
def q_registry_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.adhoc_sql(spark, f"SELECT {O.BAD_REGISTRY} FROM bad_suppliers", bad_suppliers=tb.read_table(spark, sf_dir, "supplier"))
    return cs.registry_violations(rows).select("id", F.explode("violations").alias("rule"))


@register("row_defaults", O.with_(O.REGISTRY) + """SELECT version, coalesce(CASE WHEN s_suppkey % 2 = 0
  THEN is_active END, false) AS is_active, 'pending' AS status FROM reg""")
def q_row_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = tb.registry_view(spark, sf_dir)
    # odd suppliers' versions arrive without an is_active value and without a status
    nat = F.regexp_extract("version", r"^v\d+\.(\d+)", 1).cast("int")
    raw = reg.select("version", F.when(F.pmod(nat, F.lit(2)) == 0, F.col("is_active")).alias("is_active"),
                     F.lit(None).cast("string").alias("status"))
    return cs.with_defaults(raw, {**cs.REGISTRY_DEFAULTS, **cs.SYNC_DEFAULTS})


def _raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, untyped feature values as an external feature source would deliver them."""
    from propensity.functions import cleaning as fcl
    q = fcl.quote
    return _raw(spark, sf_dir).selectExpr(
        "input_order AS lead_id",
        f"{fcl.number_sql(fcl.strip_sql(q('TotalVisits')))} AS days_since_last_visit",
        f"{fcl.number_sql(fcl.strip_sql(q('Page Views Per Visit')))} AS avg_pages_per_session",
        f"{fcl.flag_sql(fcl.strip_sql(q('Converted')))} AS viewed_pricing",
        f"{fcl.strip_sql(q('TotalVisits'))} AS total_sessions",  # text where a number is due
        f"{fcl.strip_sql(q('Converted'))} AS requested_demo",  # text where a boolean is due
        f"CAST({fcl.flag_sql(fcl.strip_sql(q('Converted')))} AS INT) AS downloaded_content",  # so is a number
        f"{fcl.flag_sql(fcl.strip_sql(q('Converted')))} AS pricing_page_views",  # a boolean counts as a number
        f"{fcl.strip_sql(q('Lead Origin'))} AS company_size_bucket",
        f"lower({fcl.strip_sql(q('What is your current occupation'))}) AS job_title_seniority")


_RAWF_SQL = _C + """, rf AS (SELECT input_order AS lead_id, """ + O.sql_number('"TotalVisits"') + """ AS dslv,
  """ + O.sql_number('"Page Views Per Visit"') + """ AS apps,
  CASE WHEN (""" + O.sql_number('"Converted"') + """) = 1 THEN true WHEN (""" + O.sql_number('"Converted"') + """) = 0
       THEN false END AS vp,
  "TotalVisits" AS ts, "Converted" AS rd,
  "Lead Origin" AS csb, lower("What is your current occupation") AS jts FROM st)
"""


@register("validate_features", _RAWF_SQL + """SELECT lead_id,
  CASE WHEN dslv IS NOT NULL AND NOT isnan(dslv) AND NOT isinf(dslv) THEN dslv ELSE 365.0 END
    AS days_since_last_visit,
  CASE WHEN apps IS NOT NULL AND NOT isnan(apps) AND NOT isinf(apps) THEN apps ELSE 0.0 END AS avg_pages_per_session,
  coalesce(vp, false) AS viewed_pricing, CAST(0 AS BIGINT) AS total_sessions, false AS requested_demo,
  false AS downloaded_content, coalesce(CAST(vp AS BIGINT), 0) AS pricing_page_views,
  CASE WHEN csb IN ('unknown', '1-10', '11-50', '51-200', '201-1000', '1000+') THEN csb ELSE 'unknown' END
    AS company_size_bucket,
  CASE WHEN jts IN ('unknown', 'individual_contributor', 'manager', 'director', 'vp', 'c_level') THEN jts
       ELSE 'unknown' END AS job_title_seniority
FROM rf""")
def q_validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["days_since_last_visit", "avg_pages_per_session", "viewed_pricing", "total_sessions", "requested_demo",
            "downloaded_content", "pricing_page_views", "company_size_bucket", "job_title_seniority"]
    return feat.apply_defaults(_raw_features(spark, sf_dir)).select("lead_id", *keep)


@register("invalid_feature_report", _RAWF_SQL + """SELECT lead_id, 'company_size_bucket' AS feature, csb AS value,
  'unknown' AS default_value FROM rf
WHERE csb IS NOT NULL AND csb NOT IN ('unknown', '1-10', '11-50', '51-200', '201-1000', '1000+')
UNION ALL SELECT lead_id, 'job_title_seniority', jts, 'unknown' FROM rf
WHERE jts IS NOT NULL AND jts NOT IN ('unknown', 'individual_contributor', 'manager', 'director', 'vp', 'c_level')
UNION ALL SELECT lead_id, 'total_sessions', ts, '0' FROM rf WHERE ts IS NOT NULL
UNION ALL SELECT lead_id, 'requested_demo', rd, 'false' FROM rf WHERE rd IS NOT NULL
UNION ALL SELECT lead_id, 'downloaded_content', CAST(CAST(vp AS INTEGER) AS VARCHAR), 'false' FROM rf WHERE vp IS NOT NULL""")
def q_invalid_feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.invalid_feature_report(_raw_features(spark, sf_dir))


@register("invalid_feature_counts", "SELECT feature, count(*) AS n_invalid FROM (" + ORACLE["invalid_feature_report"]
          + ") r GROUP BY feature UNION ALL SELECT 'rows', count(*) FROM customer")
def q_invalid_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid values per feature, counted while the rows with their defaults are written."""
    import uuid
    rows, seen = feat.apply_defaults_counted(_raw_features(spark, sf_dir))
    rows.write.parquet(scratch_path(spark, f"features/{uuid.uuid4().hex}"))
    return spark.createDataFrame([(k, v) for k, v in seen.get.items() if v], "feature string, n_invalid long")


# ---------------------------------------------------------------------------
# V3: features that fail for some leads
# ---------------------------------------------------------------------------

def _failing_catalogue():
    """Builders that go wrong on some leads: text that is no number, no e-mail click to divide by."""
    text = F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit("n/a")).otherwise(F.get_json_object("properties", "$.k"))
    is_ = lambda t: F.col("event_type") == t
    cat = with_builder(default_catalogue, "total_sessions", lambda a: ck.checked_sum(ck.checked_cast(text, "bigint")))
    cat = with_builder(cat, "avg_pages_per_session",
                       lambda a: ck.checked_divide(ck.checked_count(is_("page_view")), ck.checked_count(is_("email_click"))))
    cat = with_builder(cat, "days_since_first_touch", lambda a: F.sum(text.cast("bigint")))  # not checked: its rows give NULL
    return with_builder(cat, "emails_opened_30d", lambda a: F.sum("no_such_column"))


_FAILING = O.with_(O.EV, O.LEADS) + f""", x AS (SELECT ev.lead_id, ev.event_type, CASE WHEN ev.event_id % 11 = 0 THEN 'n/a'
    ELSE json_extract_string(r.props, '$.k') END AS text
  FROM ev JOIN events r ON r.event_id = ev.event_id WHERE occurred_at < {O.NOW}),
g AS (SELECT lead_id, count(*) FILTER (WHERE text = 'n/a') AS bad, CAST(sum(TRY_CAST(text AS BIGINT)) AS BIGINT) AS total,
  count(*) FILTER (WHERE event_type = 'page_view') AS views, count(*) FILTER (WHERE event_type = 'email_click') AS clicks
  FROM x GROUP BY lead_id)
"""


@register("failed_feature_isolation", _FAILING + f""", p AS (SELECT lead_id, count(*) AS pv FROM ev WHERE event_type = 'page_view'
  AND occurred_at < {O.NOW} AND occurred_at >= {O.NOW} - INTERVAL 7 DAY GROUP BY lead_id)
SELECT l.lead_id, CASE WHEN g.bad = 0 THEN coalesce(g.total, 0) ELSE 0 END AS total_sessions,
  CASE WHEN g.clicks > 0 THEN g.views / g.clicks ELSE 0.0 END AS avg_pages_per_session,
  coalesce(g.total, 0) AS days_since_first_touch, CAST(0 AS BIGINT) AS emails_opened_30d, coalesce(p.pv, 0) AS total_pageviews_7d
FROM leads l LEFT JOIN g ON g.lead_id = l.lead_id LEFT JOIN p ON p.lead_id = l.lead_id""")
def q_failed_feature_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = feat.feature_matrix(tb.leads_view(spark, sf_dir), tb.events_view(spark, sf_dir), as_of=tb.FIXTURE_NOW,
                             catalogue=_failing_catalogue())
    return fm.select("lead_id", "total_sessions", "avg_pages_per_session", "days_since_first_touch", "emails_opened_30d",
                     "total_pageviews_7d")


@register("failed_feature_report", _FAILING + """SELECT g.lead_id, 'total_sessions' AS feature, 'cannot cast ''n/a'' to bigint' AS error
FROM g JOIN leads l ON l.lead_id = g.lead_id WHERE bad > 0
UNION ALL SELECT g.lead_id, 'avg_pages_per_session', 'division by zero' FROM g JOIN leads l ON l.lead_id = g.lead_id WHERE clicks = 0""")
def q_failed_feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.feature_failures(tb.leads_view(spark, sf_dir), tb.events_view(spark, sf_dir), _failing_catalogue(),
                                 as_of=tb.FIXTURE_NOW)


_SIZE_CASE = """CASE trim(company_size) WHEN '1' THEN '1-10' WHEN '2' THEN '1-10' WHEN '3' THEN '1-10'
  WHEN '4' THEN '1-10' WHEN '5' THEN '1-10' WHEN '6' THEN '1-10' WHEN '7' THEN '1-10' WHEN '8' THEN '1-10'
  WHEN '9' THEN '1-10' WHEN '10' THEN '1-10' WHEN '11-50' THEN '11-50' WHEN '51-200' THEN '51-200'
  WHEN '201-500' THEN '201-1000' WHEN '501-1000' THEN '201-1000' WHEN '1001-5000' THEN '1000+'
  WHEN '5001-10000' THEN '1000+' WHEN '10000+' THEN '1000+' ELSE 'unknown' END"""


@register("normalize_company_size", O.with_(O.CRM) + f"SELECT lead_id, {_SIZE_CASE} AS company_size_bucket FROM crm")
def q_normalize_company_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = tb.crm_contacts_view(spark, sf_dir)
    return crm.select("lead_id", ru.normalize_company_size("company_size").alias("company_size_bucket"))


@register("crm_industry_match", O.with_(O.CRM) + f"""SELECT lead_id,
  industry IN ('Technology', 'Software', 'SaaS', 'Information Technology', 'Computer Software', 'Internet',
               'Financial Services', 'Marketing and Advertising')
  AND list_position(['unknown', '1-10', '11-50', '51-200', '201-1000', '1000+'], {_SIZE_CASE}) >= 3
  AS industry_match_icp FROM crm""")
def q_crm_industry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = tb.crm_contacts_view(spark, sf_dir)
    size = ru.normalize_company_size("company_size")
    return crm.select("lead_id", ru.icp_match(F.col("industry"), size).alias("industry_match_icp"))


@register("decision_maker_title", O.with_(O.CRM) + """SELECT lead_id,
  regexp_matches(job_title, '(?i)(CEO|CTO|CFO|COO|CMO|VP|Vice President|Director|Head of|Chief)') AS is_decision_maker
FROM crm""")
def q_decision_maker_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    crm = tb.crm_contacts_view(spark, sf_dir)
    return crm.select("lead_id", ru.is_decision_maker("job_title").alias("is_decision_maker"))


@register("crm_rename", O.with_(O.PREDICTIONS) +
          "SELECT lead_id, score AS lead_score, bucket AS lead_score_bucket, "
          "model_version AS lead_score_model_version FROM pred")
def q_crm_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.crm_rename(tb.predictions_view(spark, sf_dir), "hubspot", "out")


@register("crm_rename_inbound", O.with_(O.EV, O.LEADS) +
          "SELECT lead_id, lead_source AS industry, external_id AS company_name, created_at FROM leads")
def q_crm_rename_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = tb.leads_view(spark, sf_dir).select("lead_id", F.col("lead_source").alias("Industry"),
                                                   F.col("external_id").alias("Company"), F.col("created_at").alias("CreatedDate"))
    return ru.crm_rename(contacts, "salesforce", "in")


@register("crm_event_types", O.with_(O.EV) + """SELECT event_type, crm_type, count(*) AS n,
  CASE crm_type WHEN 'PAGE_VIEW' THEN 'page_view' WHEN 'EMAIL_OPEN' THEN 'email_open' WHEN 'EMAIL_CLICK' THEN 'email_click'
    WHEN 'FORM_SUBMISSION' THEN 'form_submission' END AS back
FROM (SELECT event_type, CASE WHEN event_type <> 'email_unsubscribe' THEN upper(event_type) END AS crm_type FROM ev) x
GROUP BY event_type, crm_type""")
def q_crm_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir).select("event_type", ru.crm_event_type("event_type").alias("crm_type"))
    return ev.groupBy("event_type", "crm_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "back", ru.crm_event_type("crm_type", "in"))


# ---------------------------------------------------------------------------
# ML M1-M3, M8, M10, K1-K3 (model-dependent: rows-only checks, no SQL oracle)
# ---------------------------------------------------------------------------

_TRAINED: dict[tuple, object] = {}


def _trained(spark: SparkSession, sf_dir: str):
    """Train once per session and state of the tables' files (fit = GBT on the time-split train rows)."""
    base = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, base,
           *(tuple(sorted(files.modified(spark, f"{base}/{t}.parquet").items())) for t in ("events", "customer")))
    if key not in _TRAINED:
        ts = checkpoint(q_training_dataset(spark, sf_dir))
        train = ts.where(F.col("split") == "train")
        test = ts.where(F.col("split") == "test")
        _TRAINED[key] = md.train_model(train, test)
    return _TRAINED[key]


@register("assemble_features", ORACLE["training_dataset"].replace(
    "SELECT lead_id, as_of, " + O.MODEL_FEATURE_LIST + ", converted,", "SELECT lead_id, " + ", ".join(
        f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate(MODEL_FEATURES)) + ",", 1).replace(
    "\nFROM fm", "\nFROM fm) x, LATERAL (VALUES " + ", ".join(
        f"({i}, f{i})" for i in range(len(MODEL_FEATURES))) + ") v(idx, value)", 1).replace(
    "\nSELECT lead_id, CAST(", "\nSELECT lead_id, CAST(idx AS BIGINT) AS idx, value FROM (SELECT lead_id, CAST(", 1))
def q_assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = q_training_dataset(spark, sf_dir)
    vec = md.assemble_features().transform(ts)
    return (vec.select("lead_id", F.posexplode(md.vector_to_array("features")).alias("idx", "value"))
            .select("lead_id", F.col("idx").cast("bigint").alias("idx"), "value"))


@register("train_classifier")
def q_train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _trained(spark, sf_dir)
    m = res.metrics
    return spark.createDataFrame(
        [(m["auc_roc"], m["precision"], m["recall"], m["f1"], m["log_loss"], m["calibration_error"])],
        "auc_roc double, precision double, recall double, f1 double, log_loss double, calibration_error double")


@register("feature_importance")
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _trained(spark, sf_dir)
    return spark.createDataFrame(sorted(res.feature_importance.items(), key=lambda kv: -kv[1]),
                                 "feature string, importance double")


@register("stratified_folds", ORACLE["training_dataset"].replace(
    "SELECT lead_id, as_of, " + O.MODEL_FEATURE_LIST + ", converted,", "SELECT lead_id, converted,", 1).replace(
    "\nFROM fm", "\nFROM fm) s WHERE split = 'train'", 1).replace(
    "\nSELECT lead_id, converted,", """
SELECT lead_id, CAST((row_number() OVER (ORDER BY converted, md5(CAST(lead_id AS VARCHAR) || ':42'), lead_id) - 1)
  % 5 AS INTEGER) AS fold FROM (SELECT lead_id, converted,""", 1))
def q_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = q_training_dataset(spark, sf_dir).where(F.col("split") == "train")
    return md.stratified_folds(ts, 5).select("lead_id", "fold")


TUNING_GRID = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.1]}


@register("tune_hyperparameters", """WITH f AS (""" + ORACLE["stratified_folds"] + """),
c AS (SELECT f.fold, count(*) AS n_rows, count(*) FILTER (WHERE t.converted) AS n_positive
      FROM f JOIN (""" + ORACLE["training_dataset"] + """) t ON t.lead_id = f.lead_id GROUP BY f.fold)
SELECT CAST(p.point AS INTEGER) AS point, CAST(p.n AS INTEGER) AS n_estimators, CAST(p.d AS INTEGER) AS max_depth, fold, n_rows,
  n_positive, true AS auc_in_range, true AS best_has_largest_mean
FROM c, (VALUES (0, 2, 2), (1, 4, 2), (2, 2, 3), (3, 4, 3)) p(point, n, d)""")
def q_tune_hyperparameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over a small grid with few rounds: one row per point and fold.  A fold whose rows
    have one class has no AUC."""
    train = checkpoint(q_training_dataset(spark, sf_dir).where(F.col("split") == "train"))
    trials = tn.search_hyperparameters(train, TUNING_GRID, cv_folds=5, parallelism=8).trials
    top = F.lit(trials.agg(F.max("mean_auc")).first()[0])
    one_class = F.col("n_positive").isin(0) | (F.col("n_positive") == F.col("n_rows"))
    return trials.select(
        "point", "n_estimators", "max_depth", "fold", "n_rows", "n_positive",
        F.coalesce(F.col("auc").between(0, 1), one_class).alias("auc_in_range"),
        (~F.col("best") | F.col("mean_auc").eqNullSafe(top)).alias("best_has_largest_mean"))


@register("score_one", """SELECT max(c_custkey) AS lead_id, 'scored' AS outcome, true AS bucket_agrees FROM customer
UNION ALL SELECT max(c_custkey) + 1, 'Lead not found', NULL FROM customer""")
def q_score_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One known lead, and one that isn't there."""
    res = _trained(spark, sf_dir)
    imps = [res.feature_importance[c] for c in MODEL_FEATURES]
    leads, events = tb.leads_view(spark, sf_dir), tb.events_view(spark, sf_dir)
    known = leads.agg(F.max("lead_id")).first()[0]
    one = sc.score_one(known, leads, events, res.model, "v1.0", imps, tb.FIXTURE_NOW).select(
        "lead_id", F.lit("scored").alias("outcome"), (F.col("bucket") == fs.score_bucket("score")).alias("bucket_agrees"))
    try:
        sc.score_one(known + 1, leads, events, res.model, "v1.0", imps, tb.FIXTURE_NOW)
        outcome = "scored"
    except LookupError as exc:
        outcome = str(exc).split(":")[0]
    return one.unionByName(spark.createDataFrame([(known + 1, outcome, None)], "lead_id long, outcome string, bucket_agrees boolean"))


def _score(spark: SparkSession, sf_dir: str):
    res = _trained(spark, sf_dir)
    imps = [res.feature_importance[c] for c in MODEL_FEATURES]
    return sc.score_leads(tb.score_requests_view(spark, sf_dir), tb.leads_view(spark, sf_dir),
                          tb.events_view(spark, sf_dir), res.model, "v1.0", imps, tb.FIXTURE_NOW)


@register("score_leads")
def q_score_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _score(spark, sf_dir).results
    return r.select("lead_id", "score", "bucket", "model_version",
                    F.to_json("top_factors").alias("top_factors"), "feature_snapshot", "scored_at")


@register("partial_failures", O.with_(O.REQUESTS) + """SELECT r.lead_id, r.position, 'Lead not found' AS error
FROM req r WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = r.lead_id)""")
def q_partial_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = tb.score_requests_view(spark, sf_dir)
    leads = tb.leads_view(spark, sf_dir)
    fm = sc.batch_features(req, leads, tb.events_view(spark, sf_dir), tb.FIXTURE_NOW)
    return sc.batch_errors(req, leads, fm)


# ---------------------------------------------------------------------------
# Streaming T1 (micro-batch scoring, rows-only), T2 (sliding-window throttle)
# ---------------------------------------------------------------------------

@register("sliding_window_throttle", "WITH RECURSIVE " + O.EV + """,
r AS (SELECT event_id, lead_id, occurred_at, row_number() OVER (PARTITION BY lead_id ORDER BY occurred_at, event_id) AS i FROM ev),
s AS (
  SELECT event_id, lead_id, occurred_at, i, false AS limited, occurred_at AS newer, NULL::TIMESTAMP AS older FROM r WHERE i = 1
  UNION ALL
  SELECT r.event_id, r.lead_id, r.occurred_at, r.i, z.full, CASE WHEN z.full THEN s.newer ELSE r.occurred_at END,
         CASE WHEN z.full THEN s.older ELSE s.newer END
  FROM s JOIN r ON r.lead_id IS NOT DISTINCT FROM s.lead_id AND r.i = s.i + 1,
       LATERAL (SELECT coalesce(s.older > r.occurred_at - INTERVAL 36 HOUR, false) AS full) z)
SELECT event_id, lead_id, occurred_at, limited FROM s""")
def q_sliding_window_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir).select("event_id", "lead_id", "occurred_at")
    # two requests in 36 hours: a limit that binds on these events
    return th.throttle(ev, "lead_id", "occurred_at", tie="event_id", max_requests=2, window_seconds=36 * 3600)


@register("score_stream")
def q_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid
    res = _trained(spark, sf_dir)
    imps = [res.feature_importance[c] for c in MODEL_FEATURES]
    run = scratch_path(spark, f"score_stream/{uuid.uuid4().hex}")
    tb.score_requests_view(spark, sf_dir).repartition(4).write.parquet(f"{run}/requests")
    q = ss.score_stream(spark, f"{run}/requests", tb.leads_view(spark, sf_dir), tb.events_view(spark, sf_dir),
                        res.model, "v1.0", imps, tb.FIXTURE_NOW, f"{run}/predictions", f"{run}/checkpoint",
                        errors_dir=f"{run}/errors")
    q.awaitTermination()
    return spark.read.parquet(f"{run}/predictions").select("lead_id", "score", "bucket", "model_version")


# ---------------------------------------------------------------------------
# Remaining sources/sinks and joins: S2, S7, S8, S9, J6, J7, X1, X2, W5
# ---------------------------------------------------------------------------

@register("scan_table_pruned", O.with_(O.EV, O.LEADS) +
          "SELECT lead_id, converted, converted_at, created_at FROM leads WHERE converted IS NOT NULL")
def q_scan_table_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (tb.leads_view(spark, sf_dir).select("lead_id", "converted", "converted_at", "created_at")
            .where(F.col("converted").isNotNull()))


@register("default_as_of", O.with_(O.EV, O.LEADS, O.LABELLED) + f"""
SELECT l.lead_id, coalesce(lab.as_of, {O.NOW}) AS as_of FROM leads l
LEFT JOIN lab ON lab.lead_id = l.lead_id AND lab.converted""")
def q_default_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _labelled_with_as_of(spark, sf_dir).where(F.col("converted")).select("lead_id", "as_of")
    return feat.resolve_as_of(tb.leads_view(spark, sf_dir).select("lead_id"), given, tb.FIXTURE_NOW)


@register("relationship_traversal", O.with_(O.EV, O.LEADS) + """
SELECT l.lead_id, l.external_id, ev.event_id, ev.event_type FROM leads l JOIN ev ON ev.lead_id = l.lead_id""")
def q_relationship_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id", "external_id")
    ev = tb.events_view(spark, sf_dir).select("lead_id", "event_id", "event_type")
    return jn.nest_children(leads, ev)


@register("prediction_traversal", O.with_(O.EV, O.LEADS, O.PREDICTIONS) + """
SELECT l.lead_id, l.external_id, pred.score AS prediction_score, pred.bucket AS prediction_bucket
FROM leads l JOIN pred ON pred.lead_id = l.lead_id""")
def q_prediction_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id", "external_id")
    predictions = tb.predictions_view(spark, sf_dir).select("lead_id", "score", "bucket")
    return jn.nest_children(leads, predictions, prefix="prediction_")


@register("update_by_key", O.with_(O.EV, O.LEADS) + "SELECT lead_id, converted_at FROM leads")
def q_update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (tb.read_table(spark, sf_dir, "customer")
            .select(F.col("c_custkey").alias("lead_id"), F.lit(None).cast("timestamp_ntz").alias("converted_at")))
    return jn.update_by_key(base, tb.conversions(spark, sf_dir), "lead_id", ["converted_at"])


@register("update_partitions", O.with_(O.EV, O.LEADS) + """, touched AS (
  SELECT DISTINCT lead_id % 20 AS part FROM leads WHERE converted_at >= TIMESTAMP '2024-01-20 00:00:00')
SELECT lead_id, CASE WHEN converted_at >= TIMESTAMP '2024-01-20 00:00:00' THEN converted_at END AS converted_at,
  (SELECT count(*) FROM touched) AS n_rewritten FROM leads""")
def q_update_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late conversions written into a stored, partitioned table of leads."""
    import uuid
    path = scratch_path(spark, f"leads_table/{uuid.uuid4().hex}")
    base = tb.read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("lead_id"), F.lit(None).cast("timestamp_ntz").alias("converted_at"),
        F.pmod("c_custkey", F.lit(20)).cast("int").alias("part"))
    base.repartition("part").write.partitionBy("part").parquet(path)
    late = tb.conversions(spark, sf_dir).where(F.col("converted_at") >= tb.ntz("2024-01-20 00:00:00"))
    rewritten = jn.update_partitions(spark, path, late, "lead_id", ["converted_at"], ("part",))
    return spark.read.parquet(path).select("lead_id", "converted_at", F.lit(len(rewritten)).cast("bigint").alias("n_rewritten"))


@register("delete_cascade", O.with_(O.EV, O.REQUESTS) +
          "SELECT event_id, lead_id FROM ev WHERE lead_id NOT IN (SELECT lead_id FROM req)")
def q_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = tb.score_requests_view(spark, sf_dir).select("lead_id")
    return jn.delete_cascade(doomed, tb.events_view(spark, sf_dir).select("event_id", "lead_id"))


@register("delete_restrict", O.with_(O.PREDICTIONS, O.REQUESTS) + """
SELECT DISTINCT c.c_custkey AS lead_id FROM customer c
WHERE c.c_custkey IN (SELECT lead_id FROM req) AND c.c_custkey IN (SELECT lead_id FROM pred)""")
def q_delete_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tb.leads_view(spark, sf_dir).select("lead_id")
    doomed = jn.lookup_by_ids(leads, tb.score_requests_view(spark, sf_dir))
    return jn.delete_restricted(doomed, tb.predictions_view(spark, sf_dir))


@register("adhoc_sql", O.with_(O.EV) + "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def q_adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.adhoc_sql(spark, "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type",
                        ev=tb.events_view(spark, sf_dir))


@register("json_get_session", O.with_(O.EV) + "SELECT event_id, session_id FROM ev")
def q_json_get_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir)
    return ev.select("event_id", fj.session_id("properties").alias("session_id"))


@register("json_nested_get", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_json_nested_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir)
    return ev.select("event_id", fj.json_nested("properties", "$.k", "int").alias("k"))


def _documents_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON built from several columns; some events have broken text instead, or no document."""
    ev = tb.read_table(spark, sf_dir, "events")
    body = F.to_json(F.struct(
        F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("kind")).alias("seen")).alias("user"),
        F.array(F.struct(F.col("value").alias("amount"), F.lit("EUR").alias("unit")),
                F.struct((F.col("value") * 2).alias("amount"), F.lit("USD").alias("unit"))).alias("items"),
        F.when(F.col("event_id") % 3 == 0, F.lit("text")).alias("note")))
    text = F.when(F.col("event_id") % 7 == 3, F.lit('{"user": {"id": 1')).when(F.col("event_id") % 7 != 4, body)
    return ev.select("event_id", fj.variant(text).alias("doc"))


@register("json_nested_paths", """SELECT event_id, CASE WHEN ok THEN user_id END AS user_id, CASE WHEN ok THEN event_type END AS kind,
  CASE WHEN ok THEN value * 2 END AS second_amount, CASE WHEN ok AND event_id % 3 = 0 THEN 'text' END AS note,
  CAST(NULL AS BIGINT) AS note_as_number, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS DOUBLE) AS beyond
FROM (SELECT *, event_id % 7 NOT IN (3, 4) AS ok FROM events) e""")
def q_json_nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_of_events(spark, sf_dir).select(
        "event_id", fj.at("doc", "$.user.id", "bigint").alias("user_id"), fj.at("doc", "$.user.seen.kind").alias("kind"),
        fj.at("doc", "$.items[1].amount", "double").alias("second_amount"), fj.at("doc", "$.note").alias("note"),
        fj.at("doc", "$.note", "bigint").alias("note_as_number"), fj.at("doc", "$.user.none.at.all").alias("missing"),
        fj.at("doc", "$.items[2].amount", "double").alias("beyond"))


@register("json_array_items", """SELECT event_id, CAST(i AS INTEGER) AS pos, CASE i WHEN 0 THEN 'EUR' ELSE 'USD' END AS unit
FROM events, range(2) t(i) WHERE event_id % 7 NOT IN (3, 4)""")
def q_json_array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fj.explode_array(_documents_of_events(spark, sf_dir), "doc", "$.items", "variant", value="item")
    return items.select("event_id", "pos", fj.at("item", "$.unit").alias("unit"))


@register("dedup_first", _C + """SELECT lead_source, input_order FROM (
  SELECT lead_source, input_order, row_number() OVER (PARTITION BY lead_source ORDER BY input_order) AS rn
  FROM valid) x WHERE rn = 1""")
def q_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = cl.prepare_load(tb.raw_leads_view(spark, sf_dir))
    return wn.dedup_first(valid.select("lead_source", "input_order"), "lead_source", ["input_order"])


# ---------------------------------------------------------------------------
# Append-only sinks S5, S6; contracts of the model path that hold whatever the trees
# ---------------------------------------------------------------------------

def _appended(spark: SparkSession, name: str, parts: list[DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    import uuid
    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    for part in parts:
        tb.append_rows(part, path, partition_by)
    return spark.read.parquet(path)


@register("append_events", O.with_(O.EV) + "SELECT event_id, lead_id, event_type, event_name, occurred_at FROM ev")
def q_append_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tb.events_view(spark, sf_dir).select("event_id", "lead_id", "event_type", "event_name", "occurred_at")
    early = F.col("occurred_at") < tb.ntz("2024-01-15 00:00:00")
    return _appended(spark, "append_events", [ev.where(early), ev.where(~early)])


@register("append_predictions", O.with_(O.PREDICTIONS) + """SELECT lead_id, score, bucket, model_version FROM pred
UNION ALL SELECT lead_id, score, bucket, model_version FROM pred""")
def q_append_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = tb.predictions_view(spark, sf_dir).select("lead_id", "score", "bucket", "model_version")
    return _appended(spark, "append_predictions", [pred, pred], ("model_version",)).select(
        "lead_id", "score", "bucket", F.col("model_version").cast("string").alias("model_version"))


@register("train_contract", """SELECT count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'test') AS n_test, CAST(17 AS BIGINT) AS n_features, true AS importances_sum_to_one,
  true AS metrics_in_range FROM (""" + ORACLE["training_dataset"] + ") t")
def q_train_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = _trained(spark, sf_dir)
    imps, m = res.feature_importance, res.metrics
    ok = all(m[k] is None or 0.0 <= m[k] <= 1.0  # AUC is null where the holdout lacks a class
             for k in ("auc_roc", "precision", "recall", "f1", "calibration_error")) and m["log_loss"] >= 0
    n = q_training_dataset(spark, sf_dir).agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                              F.count_if(F.col("split") == "test").alias("n_test"))
    return n.select("n_train", "n_test", F.lit(len(set(imps) & set(MODEL_FEATURES))).cast("bigint").alias("n_features"),
                    F.lit(abs(sum(imps.values()) - 1) < 1e-9).alias("importances_sum_to_one"), F.lit(ok).alias("metrics_in_range"))


_SCORED_SQL = """SELECT c_custkey AS lead_id, true AS bucket_agrees, true AS score_in_range, {more}
FROM customer WHERE c_custkey IN (SELECT lead_id FROM req)"""


@register("score_contract", O.with_(O.REQUESTS) + _SCORED_SQL.format(
    more="5 AS n_factors, 17 AS n_snapshot, 'v1.0' AS model_version"))
def q_score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _score(spark, sf_dir).results
    return r.select("lead_id", (F.col("bucket") == fs.score_bucket("score")).alias("bucket_agrees"),
                    F.col("score").between(0, 1).alias("score_in_range"), F.size("top_factors").alias("n_factors"),
                    F.size(F.json_object_keys("feature_snapshot")).alias("n_snapshot"), "model_version")


@register("score_stream_contract", O.with_(O.REQUESTS) + _SCORED_SQL.format(more="'v1.0' AS model_version"))
def q_score_stream_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = q_score_stream(spark, sf_dir).distinct()
    return r.select("lead_id", (F.col("bucket") == fs.score_bucket("score")).alias("bucket_agrees"),
                    F.col("score").between(0, 1).alias("score_in_range"), "model_version")


@register("model_round_trip", "SELECT lead_id, true AS same_score FROM (" + ORACLE["training_dataset"]
          + ") t WHERE split = 'test'")
def q_model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved and loaded again, the model gives every holdout row the same probability (S10, M13)."""
    import uuid
    res = _trained(spark, sf_dir)
    path = md.save_model(spark, res, "v1.0", scratch_path(spark, f"models/{uuid.uuid4().hex}"))
    test = checkpoint(q_training_dataset(spark, sf_dir).where(F.col("split") == "test"))
    loaded = md.probability(md.load_model(path).transform(test)).select("lead_id", F.col("p").alias("again"))
    return (md.probability(res.model.transform(test)).select("lead_id", "p").join(loaded, "lead_id")
            .select("lead_id", (F.col("p") == F.col("again")).alias("same_score")))
