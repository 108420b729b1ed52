"""Point-in-time behavioural features: one join + one two-level aggregation.

The original computes 17 Python functions per lead over that lead's events.  Here
the whole batch is one plan:

1. ``pit_join``: every event meets its own lead's cut-off ``as_of``; only events
   strictly before it survive.  With one shared cut-off ("now") there is no join
   at all, just a pushed-down filter.
2. level 1 groups by (lead, session): all features are decomposable (counts,
   min/max, signed sums), so partial aggregation runs before every shuffle and a
   hot lead is spread over its sessions; session size and duration come out of
   the same pass.
3. level 2 groups by lead and merges level 1; the result is hash-partitioned by
   lead_id, so the final left join that keeps event-less leads only moves the
   leads side.
4. catalogue defaults replace missing values (``apply_defaults``).
"""

from __future__ import annotations

import logging

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensity.catalogue import Catalogue, default_catalogue, spark_type
from propensity.functions.checked import Checked
from propensity.functions.json import session_id as json_session_id
from propensity.functions.time import as_timestamp, seconds_between

log = logging.getLogger(__name__)

PAGE_VIEW = "page_view"
EMAIL_OPEN = "email_open"
EMAIL_CLICK = "email_click"
FORM = "form_submission"
UNSUBSCRIBE = "email_unsubscribe"

EVENT_COLUMNS = ("lead_id", "event_type", "event_name", "occurred_at", "session_id")


def _events_for_features(events: DataFrame, whole: bool = False) -> DataFrame:
    """Project the columns the features read (column pruning reaches the scan), and with
    ``whole`` the others too, which builders may read."""
    sess = F.col("session_id") if "session_id" in events.columns else json_session_id("properties")
    sess = F.nullif(sess, F.lit(""))
    more = [c for c in events.columns if c not in EVENT_COLUMNS and c != "as_of"] if whole else []
    return events.select("lead_id", "event_type", "event_name", "occurred_at", sess.alias("session_id"), *more)


# Target events per join task for a hot lead.
ROWS_PER_TASK = 2_000_000


def hot_keys(events: DataFrame, key: str = "lead_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key, _pit_k): keys owning more than ``rows_per_task`` rows and the number of
    salt buckets each needs (ceil(rows / rows_per_task)).

    Per-key counts are a partial aggregate over one column, part of the plan: nothing
    runs while the plan is built.  Fewer than rows / rows_per_task keys are listed, so
    adaptive execution broadcasts the list wherever its measured size allows.
    """
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (counts.where(F.col("_n") > int(rows_per_task))
            .select(F.col(key), F.ceil(F.col("_n") / F.lit(float(rows_per_task))).cast("int").alias("_pit_k")))


def pit_join(leads_asof: DataFrame, events: DataFrame, as_of_col: str = "as_of",
             salt_buckets: int | None = None, as_of_upper=None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Events strictly before their own lead's cut-off, with the cut-off attached.

    ``leads_asof`` has one row per lead (lead_id, as_of).  Skew handling:

    * default (``salt_buckets=None``): adaptive salting.  Leads owning more than
      ``rows_per_task`` events get ceil(n / rows_per_task) salt buckets (from
      ``hot_keys``); each of their events picks a bucket by a
      hash of its own columns and only their (lead_id, as_of) row is replicated per
      bucket, so a lead with a third of all events spreads over many join tasks
      while ordinary leads are joined unchanged.
    * ``salt_buckets=k``: every lead salted into k buckets; ``1`` disables salting.

    ``as_of_upper`` (an upper bound of every cut-off) is applied to the event scan so
    Parquet can skip row groups.  Leads without qualifying events are absent here;
    ``feature_matrix`` keeps them.
    """
    ev = events
    if as_of_upper is not None:
        ev = ev.where(F.col("occurred_at") < as_of_timestamp(as_of_upper))
    la = leads_asof.select(F.col("lead_id").alias("_pit_lead"), F.col(as_of_col).alias("as_of"))
    if salt_buckets == 1:
        cond = (ev["lead_id"] == la["_pit_lead"]) & (ev["occurred_at"] < la["as_of"])
        return ev.join(la, cond, "inner").drop("_pit_lead")
    h = F.xxhash64(*ev.columns)
    if salt_buckets is None:
        hot = hot_keys(ev, rows_per_task=rows_per_task)
        ev = ev.join(hot, "lead_id", "left").withColumn("_pit_k", F.coalesce(F.col("_pit_k"), F.lit(1)))
        la = (la.join(hot.withColumnRenamed("lead_id", "_pit_lead"), "_pit_lead", "left")
              .withColumn("_pit_k", F.coalesce(F.col("_pit_k"), F.lit(1))))
        k_ev, k_la = F.col("_pit_k"), F.col("_pit_k")
    else:
        k_ev = k_la = F.lit(int(salt_buckets))
    ev = ev.withColumn("_pit_salt", F.pmod(h, k_ev.cast("bigint")))
    la = la.withColumn("_pit_lsalt", F.explode(F.sequence(F.lit(0).cast("bigint"), (k_la - 1).cast("bigint"))))
    ev = ev.drop("_pit_k")
    la = la.drop("_pit_k")
    cond = ((ev["lead_id"] == la["_pit_lead"]) & (ev["_pit_salt"] == la["_pit_lsalt"])
            & (ev["occurred_at"] < la["as_of"]))
    return ev.join(la, cond, "inner").drop("_pit_lead", "_pit_salt", "_pit_lsalt")


def as_of_timestamp(value) -> Column:
    return as_timestamp(value)


def pit_filter(events: DataFrame, as_of) -> DataFrame:
    """Events strictly before one shared cut-off, with the cut-off attached."""
    a = as_of_timestamp(as_of)
    return events.where(F.col("occurred_at") < a).withColumn("as_of", a)


# The wide expression lists below are SQL expression strings: each is parsed once
# on the JVM, which keeps plan construction to a few calls instead of thousands.
_DAY_US = 86_400_000_000


def _in_window_sql(days: float) -> str:
    us = int(round(days * _DAY_US))
    return f"(occurred_at >= timestampadd(MICROSECOND, -{us}, as_of) AND occurred_at < as_of)"


def _level1(pit: DataFrame) -> DataFrame:
    pv = f"event_type = '{PAGE_VIEW}'"
    sign = f"(CASE WHEN event_type = '{UNSUBSCRIBE}' THEN -1 ELSE 1 END)"
    mid = f"timestampadd(MICROSECOND, -{int(3.5 * _DAY_US)}, as_of)"
    start = f"timestampadd(MICROSECOND, -{7 * _DAY_US}, as_of)"
    velocity = (f"CASE WHEN occurred_at >= {mid} AND occurred_at < as_of THEN {sign} "
                f"WHEN occurred_at >= {start} AND occurred_at < {mid} THEN -{sign} ELSE 0 END")
    aggs = [
        "max(as_of) AS as_of",
        f"max(CASE WHEN {pv} THEN occurred_at END) AS last_pv",
        f"max(CASE WHEN event_type = '{EMAIL_OPEN}' THEN occurred_at END) AS last_eo",
        "min(occurred_at) AS first_t",
        "max(occurred_at) AS last_t",
        "count(1) AS n_rows",
        f"count_if({pv} AND {_in_window_sql(7)}) AS pv_7d",
        f"count_if({pv} AND {_in_window_sql(30)}) AS pv_30d",
        f"count_if(event_type = '{EMAIL_OPEN}' AND {_in_window_sql(30)}) AS eo_30d",
        f"count_if(event_type = '{EMAIL_CLICK}' AND {_in_window_sql(30)}) AS ec_30d",
        f"count_if({pv} AND event_name = 'Pricing') AS pricing",
        f"count_if({pv} AND event_name = 'Competitor Comparison') AS competitor",
        f"count_if(event_type = '{FORM}' AND event_name = 'Demo Request') AS demo",
        f"count_if(event_type = '{FORM}' AND event_name = 'Content Download') AS content",
        f"CAST(sum({velocity}) AS BIGINT) AS velocity",
    ]
    keyed = pit.selectExpr("*", f"CASE WHEN {pv} THEN session_id END AS session_key")
    return keyed.groupBy("lead_id", "session_key").agg(*[F.expr(x) for x in aggs])


def _days(ts_agg: str) -> str:
    return f"CAST(floor(timestampdiff(MICROSECOND, {ts_agg}, max(as_of)) / {float(_DAY_US)}) AS BIGINT)"


def _level2(l1: DataFrame) -> DataFrame:
    aggs = [
        "max(as_of) AS as_of",
        f"{_days('max(last_pv)')} AS days_since_last_visit",
        f"{_days('max(last_eo)')} AS days_since_last_email_open",
        f"{_days('min(first_t)')} AS days_since_first_touch",
        "sum(pv_7d) AS total_pageviews_7d",
        "sum(pv_30d) AS total_pageviews_30d",
        "count(session_key) AS total_sessions",
        "sum(eo_30d) AS emails_opened_30d",
        "sum(ec_30d) AS emails_clicked_30d",
        "avg(CASE WHEN session_key IS NOT NULL THEN n_rows END) AS avg_pages_per_session",
        # exact integer microseconds summed, one division: order-independent result
        "sum(CASE WHEN session_key IS NOT NULL THEN timestampdiff(MICROSECOND, first_t, last_t) END)"
        " / count(session_key) / 1000000.0D AS avg_session_duration_seconds",
        "sum(pricing) AS pricing_page_views",
        "sum(pricing) > 0 AS viewed_pricing",
        "sum(demo) > 0 AS requested_demo",
        "sum(content) > 0 AS downloaded_content",
        "sum(competitor) > 0 AS visited_competitor_comparison",
        "sum(velocity) AS engagement_velocity_7d",
    ]
    return l1.groupBy("lead_id").agg(*[F.expr(x) for x in aggs])


def session_rollup(pit: DataFrame) -> DataFrame:
    """Per (lead, session): page views and duration in seconds (max - min)."""
    ev = _events_for_features(pit) if "session_id" not in pit.columns else pit
    t = F.col("occurred_at")
    return (ev.where((F.col("event_type") == PAGE_VIEW) & F.col("session_id").isNotNull())
            .groupBy("lead_id", "session_id")
            .agg(F.count(F.lit(1)).alias("page_views"),
                 seconds_between(F.min(t), F.max(t)).alias("duration_seconds")))


def feature_aggregates(pit: DataFrame) -> DataFrame:
    """Raw (not yet defaulted) features per lead from point-in-time event rows."""
    agg = _level2(_level1(pit))
    return agg.selectExpr("*", "engagement_velocity_7d > 0 AS is_engagement_increasing")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


_SQL_TYPES = {"LongType()": "BIGINT", "DoubleType()": "DOUBLE", "BooleanType()": "BOOLEAN", "StringType()": "STRING"}


def _sql_type(feature) -> str:
    return _SQL_TYPES[repr(spark_type(feature))]


def _right_type(feature, dtype: T.DataType) -> bool:
    """Whether a column of this type can hold valid values of the feature at all: numbers
    and booleans (true is 1, false is 0; not text) for numeric, booleans for boolean, text
    for categorical."""
    wanted = {"numeric": (T.NumericType, T.BooleanType), "boolean": T.BooleanType, "categorical": T.StringType}
    return isinstance(dtype, wanted[feature.type])


def validity_sql(feature, col: str, dtype: T.DataType) -> str:
    """SQL: true when a present value is valid for the feature's type, NULL when absent.
    A column of another type is never cast: all its values are invalid."""
    c = _q(col)
    if not _right_type(feature, dtype):
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE false END"
    if feature.type == "numeric" and not isinstance(dtype, T.BooleanType):
        d = f"CAST({c} AS DOUBLE)"
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE NOT (isnan({d}) OR abs({d}) = double('inf')) END"
    if feature.type == "categorical":
        cats = ", ".join(_sql_literal(x) for x in feature.categories)
        return f"CASE WHEN {c} IS NULL THEN NULL ELSE {c} IN ({cats}) END"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE true END"


def apply_defaults(df: DataFrame, catalogue: Catalogue = default_catalogue, keep=("lead_id", "as_of")) -> DataFrame:
    """Every catalogue feature present, valid and typed; invalid or missing -> default.

    Numeric: finite numbers, and booleans as 1 and 0; boolean: booleans only; categorical:
    one of the listed categories.  Text in a numeric or boolean column, and numbers in a boolean
    one, are invalid whatever they say.  A numeric column with fractions stays a double.
    """
    types = {f.name: f.dataType for f in df.schema}
    out = [_q(k) for k in keep if k in types]
    for f in catalogue.features:
        dtype, typ = types.get(f.name), _sql_type(f)
        if isinstance(dtype, (T.FractionalType, T.DecimalType)) and f.type == "numeric":
            typ = "DOUBLE"
        default = f"CAST({_sql_literal(f.default)} AS {typ})"
        if dtype is None or not _right_type(f, dtype):
            out.append(f"{default} AS {_q(f.name)}")
            continue
        ok = f"coalesce({validity_sql(f, f.name, dtype)}, false)"
        out.append(f"CASE WHEN {ok} THEN CAST({_q(f.name)} AS {typ}) ELSE {default} END AS {_q(f.name)}")
    return df.selectExpr(*out)


def apply_defaults_counted(df: DataFrame, catalogue: Catalogue = default_catalogue, keep=("lead_id", "as_of"),
                           name: str = "invalid_features") -> tuple[DataFrame, Observation]:
    """``apply_defaults`` and, from the same pass over the rows, how many present values of
    each feature were invalid: ``observation.get`` has them by feature name, and the number
    of rows as ``rows``, once the frame was written or counted.

    The counters ride on the rows as metrics of the tasks, so they cost no second scan and no
    shuffle.  A task that runs again replaces its own metrics."""
    types = {f.name: f.dataType for f in df.schema}
    seen = Observation(name)
    counts = [F.expr(f"count_if(coalesce(NOT ({validity_sql(f, f.name, types[f.name])}), false))").alias(f.name)
              for f in catalogue.features if f.name in types]
    return apply_defaults(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), catalogue, keep), seen


def invalid_feature_report(df: DataFrame, catalogue: Catalogue = default_catalogue, key: str = "lead_id") -> DataFrame:
    """Present-but-invalid values: (lead_id, feature, value, default), one row each."""
    types = {f.name: f.dataType for f in df.schema}
    rows = []
    for f in catalogue.features:
        if f.name not in types:
            continue
        bad = f"coalesce(NOT ({validity_sql(f, f.name, types[f.name])}), false)"
        dv = str(f.default).lower() if isinstance(f.default, bool) else str(f.default)
        rows.append(f"CASE WHEN {bad} THEN named_struct('feature', {_sql_literal(f.name)}, "
                    f"'value', CAST({_q(f.name)} AS STRING), 'default_value', {_sql_literal(dv)}) END")
    if not rows:
        return df.selectExpr(_q(key), "CAST(NULL AS STRING) AS feature", "CAST(NULL AS STRING) AS value",
                             "CAST(NULL AS STRING) AS default_value").limit(0)
    return (df.selectExpr(_q(key), f"explode(array_compact(array({', '.join(rows)}))) AS r")
            .select(key, "r.feature", "r.value", "r.default_value"))


@contextmanager
def _errors_as_null(spark: SparkSession):
    """Expressions analysed inside give NULL instead of failing the job where a cast, a division
    or an array access goes wrong.  The setting is fixed in a plan when it is analysed, so it is
    put back at once and holds for nothing else."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def _custom_features(pit: DataFrame, catalogue: Catalogue) -> DataFrame | None:
    """User-registered aggregate builders, each isolated from the others: one row per lead with
    ``<name>`` and ``_error_<name>``.

    * A builder that raises, or whose expression can't be analysed, is logged and left out, and
      its feature gets the default for all leads.
    * A builder of checked expressions (``functions.checked``) carries the first error of a
      lead's rows along: the feature is NULL there, so it gets the default, and the error is
      reported (``feature_failures``).
    * Any other expression is analysed so that a failing cast, division or array access gives
      NULL for its row; nothing is reported then.  ``raise_error`` and Python UDFs still fail the job.
    """
    a = F.col("as_of")
    cols = []
    with _errors_as_null(pit.sparkSession):
        for name, fn in catalogue.builders.items():
            try:
                built = fn(a)
                checked = built if isinstance(built, Checked) else Checked(built, F.lit(None).cast("string"))
                error = F.max(checked.error) if not isinstance(built, Checked) else checked.error
                mine = [F.when(error.isNull(), checked.value).alias(name), error.alias(f"_error_{name}")]
                pit.groupBy("lead_id").agg(*mine).schema  # analysis errors surface here, per feature
                cols += mine
            except Exception as exc:  # noqa: BLE001 - isolate one bad feature
                log.warning("feature_computation_failed feature=%s error=%s", name, exc)
        return pit.groupBy("lead_id").agg(*cols) if cols else None


def feature_failures(leads: DataFrame, events: DataFrame, catalogue: Catalogue, as_of=None, as_of_col: str | None = None,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``(lead_id, feature, error)``: one row for each feature that failed for a lead, in which
    ``feature_matrix`` with the same arguments has the default."""
    pit, ids = _point_in_time(leads, events, as_of, as_of_col, rows_per_task=rows_per_task)
    custom = _custom_features(pit, catalogue)
    names = [c.removeprefix("_error_") for c in (custom.columns if custom is not None else []) if c.startswith("_error_")]
    if not names:
        return ids.select("lead_id", F.lit("").alias("feature"), F.lit("").alias("error")).limit(0)
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_error_{n}").alias("error")) for n in names]),
                     lambda e: e["error"].isNotNull())
    failed = custom.select("lead_id", F.explode(found).alias("f")).select("lead_id", "f.feature", "f.error")
    return failed.join(ids.select("lead_id"), "lead_id", "left_semi")


REQUEST_SALTS = 16

# Requests of more leads are not broadcast: with their salts they are some tens of megabytes.
REQUEST_BROADCAST_ROWS = 20_000


def requested_events(events: DataFrame, leads: DataFrame, salts: int = REQUEST_SALTS,
                     broadcast_rows: int = REQUEST_BROADCAST_ROWS) -> DataFrame:
    """Events of the requested leads.  The semi join is salted: a request is repeated for
    each of ``salts`` parts of its lead's events, so a lead with a third of all events is
    spread over as many tasks; a small request side is broadcast by Spark's size check.

    That check goes by the files the leads come from, packed and without the ``salts`` copies, and
    so would broadcast millions of rows too: the requested leads are counted, and many are sort-merged."""
    salt = F.pmod(F.xxhash64("occurred_at", "event_type", "event_name", "session_id"), F.lit(salts))
    ids = leads.select("lead_id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    if leads.count() > broadcast_rows:
        ids = ids.hint("merge")
    return events.withColumn("_salt", salt.cast("bigint")).join(ids, ["lead_id", "_salt"], "left_semi").drop("_salt")


def _point_in_time(leads: DataFrame, events: DataFrame, as_of=None, as_of_col: str | None = None, salt_buckets: int | None = None,
                   as_of_upper=None, carry: tuple = (), restrict_events: bool = False, rows_per_task: int = ROWS_PER_TASK,
                   whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """The event rows before each lead's cut-off (``whole``: with the events' other columns, for
    builders), and the leads with their cut-off."""
    ev = _events_for_features(events, whole)
    if restrict_events:
        ev = requested_events(ev, leads)
    if as_of_col is not None:
        la = leads.select("lead_id", F.col(as_of_col).alias("as_of"), *carry)
        return pit_join(la, ev, "as_of", salt_buckets=salt_buckets, as_of_upper=as_of_upper, rows_per_task=rows_per_task), la
    if as_of is None:
        raise ValueError("give either as_of (shared cut-off) or as_of_col (per-lead cut-off)")
    return pit_filter(ev, as_of), leads.select("lead_id", *carry).withColumn("as_of", as_of_timestamp(as_of))


def feature_matrix(leads: DataFrame, events: DataFrame, as_of=None, as_of_col: str | None = None,
                   catalogue: Catalogue = default_catalogue, salt_buckets: int | None = None,
                   as_of_upper=None, carry: tuple = (), restrict_events: bool = False,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All catalogue features per lead, plus lead_id and the cut-off ``as_of``.

    ``as_of_col`` names a per-lead cut-off column of ``leads`` (training); otherwise
    ``as_of`` is one shared cut-off (scoring "now").  Leads without events get
    defaults.  ``leads`` must hold one row per lead_id.  ``carry`` columns of
    ``leads`` (e.g. the label) pass through, so no second join is needed.
    ``restrict_events``: ``leads`` is a small subset (a scoring request), so events
    are semi-joined to it before aggregating instead of aggregating every lead.
    """
    pit, base = _point_in_time(leads, events, as_of, as_of_col, salt_buckets, as_of_upper, carry, restrict_events, rows_per_task,
                               whole=bool(catalogue.builders))
    feats = feature_aggregates(pit).drop("as_of")
    out = base.join(feats, "lead_id", "left")
    out = out.drop(*catalogue.builders)  # a registered name is never filled by the built-in value
    custom = _custom_features(pit, catalogue)
    if custom is not None:
        out = out.join(custom.drop(*[c for c in custom.columns if c.startswith("_error_")]), "lead_id", "left")
    return apply_defaults(out, catalogue, keep=("lead_id", "as_of", *carry))


def resolve_as_of(leads: DataFrame, as_of_dates: DataFrame | None, default) -> DataFrame:
    """Per-lead cut-off where supplied (lead_id, as_of), else one shared default."""
    d = as_of_timestamp(default)
    if as_of_dates is None:
        return leads.withColumn("as_of", d)
    return (leads.join(as_of_dates.select("lead_id", F.col("as_of").alias("_given")), "lead_id", "left")
            .withColumn("as_of", F.coalesce(F.col("_given"), d)).drop("_given"))
