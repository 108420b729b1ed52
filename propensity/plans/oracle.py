"""DuckDB SQL for the registered queries (the correctness oracle).

The oracle is written independently of the Spark plans: single-level SQL
aggregates with FILTER clauses where the Spark side uses two-level aggregation,
window functions where the Spark side uses range partitioning, and so on.  The
fixture views (events, leads, raw lead rows, scored holdout) are CTE fragments
that mirror ``propensity.sources.tables``.
"""

from __future__ import annotations

from propensity.constants import FORM_NAMES, PAGE_NAMES

NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


EV = f"""ev AS (
  SELECT event_id, user_id AS lead_id,
    CASE event_type WHEN 'view' THEN 'page_view' WHEN 'signup' THEN 'email_open'
      WHEN 'click' THEN 'email_click' WHEN 'purchase' THEN 'form_submission'
      WHEN 'error' THEN 'email_unsubscribe' END AS event_type,
    CASE WHEN event_type = 'view' THEN {_list(PAGE_NAMES)}[((k % 8) + 8) % 8 + 1]
         WHEN event_type = 'purchase' THEN {_list(FORM_NAMES)}[((k % 3) + 3) % 3 + 1] END AS event_name,
    CASE WHEN event_type = 'view' AND ((k % 10) + 10) % 10 <> 0
         THEN 's-' || strftime(ts, '%Y%m%d') END AS session_id,
    ts AS occurred_at, value
  FROM (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) r
)"""

LEADS = """conv AS (
  SELECT user_id AS lead_id, min(ts) AS converted_at FROM events
  WHERE event_type = 'purchase' AND value >= 150 GROUP BY user_id
),
leads AS (
  SELECT c.c_custkey AS lead_id, c.c_name AS external_id, 'kaggle' AS source_system,
    c.c_mktsegment AS lead_source, c.c_acctbal AS total_time_spent,
    CASE WHEN c.c_custkey % 7 = 6 THEN NULL ELSE conv.converted_at IS NOT NULL END AS converted,
    conv.converted_at,
    TIMESTAMP '2024-01-01 00:00:00' - to_days(CAST(c.c_custkey % 100 AS INTEGER)) AS created_at
  FROM customer c LEFT JOIN conv ON conv.lead_id = c.c_custkey
)"""

HOLDOUT = """ho AS (
  SELECT doc_id AS id, CAST(quality AS INTEGER) AS y,
         (((doc_id * 37) % 101) + 0.5) / 101.0 AS p
  FROM labels
)"""


def raw_leads_cte() -> str:
    origins = _list(("API", "Landing Page Submission", "Lead Add Form", "Lead Import", "Quick Add Form"))
    acts = _list(("Email Opened", "SMS Sent", "Page Visited on Website", "Olark Chat Conversation",
                  "Converted to Lead", "Select"))
    countries = _list(("India", "United States", " India ", "Select"))
    specs = _list(("Finance Management", "Human Resource Management", "Marketing Management",
                   "Select", "select", "   ", "Specialization"))
    occs = _list(("Unemployed", "Working Professional", "Student", "Select"))
    cities = _list(("Mumbai", "Thane & Outskirts", "\tMumbai\t", "Select", "Other Cities"))
    tags = _list(("Will revert after reading the email", "Ringing", "Interested in other courses", None))
    return f"""raw AS (
  SELECT
    CASE WHEN k % 50 = 0 THEN '' WHEN k % 50 = 1 THEN '   ' WHEN k % 50 = 2 THEN NULL
         WHEN k % 25 = 3 THEN 'Customer#' || lpad(CAST(k - 3 AS VARCHAR), 9, '0')
         WHEN k % 50 = 4 THEN '  ' || c_name || chr(9)
         ELSE c_name END AS "Prospect ID",
    'LN' || CAST(k + 100000 AS VARCHAR) AS "Lead Number",
    {origins}[c_nationkey % 5 + 1] AS "Lead Origin",
    CASE WHEN k % 11 = 0 THEN 'select' WHEN k % 11 = 1 THEN ' ' || c_mktsegment || ' '
         WHEN k % 11 = 2 THEN NULL WHEN k % 11 = 3 THEN '' ELSE c_mktsegment END AS "Lead Source",
    ['Yes', 'No', 'maybe', NULL, 'No'][k % 5 + 1] AS "Do Not Email",
    CASE WHEN k % 9 = 0 THEN 'Yes' WHEN k % 9 = 1 THEN 'nah' ELSE 'No' END AS "Do Not Call",
    CASE WHEN k % 13 = 0 THEN '99' WHEN k % 13 = 1 THEN 'abc' WHEN k % 13 = 2 THEN NULL
         WHEN k % 13 = 3 THEN '1.0' WHEN k % 13 = 4 THEN '0.0'
         WHEN c_acctbal > 5000 THEN '1' ELSE '0' END AS "Converted",
    CASE WHEN k % 8 = 0 THEN 'abc' WHEN k % 8 = 1 THEN '5d' WHEN k % 8 = 2 THEN ''
         WHEN k % 8 = 3 THEN NULL WHEN k % 8 = 4 THEN ' 7 ' WHEN k % 8 = 5 THEN '1e1'
         ELSE CAST((k * 7) % 30 AS VARCHAR) END AS "TotalVisits",
    CASE WHEN k % 10 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS "Total Time Spent on Website",
    CASE WHEN k % 12 = 5 THEN '' ELSE CAST((k % 37) / 4.0 AS VARCHAR) END AS "Page Views Per Visit",
    {acts}[(k // 3) % 6 + 1] AS "Last Activity",
    {countries}[c_nationkey % 4 + 1] AS "Country",
    {specs}[k % 7 + 1] AS "Specialization",
    {occs}[(k // 2) % 4 + 1] AS "What is your current occupation",
    {cities}[k % 5 + 1] AS "City",
    {tags}[(k // 5) % 4 + 1] AS "Tags",
    k AS input_order
  FROM (SELECT *, c_custkey AS k FROM customer) c
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Point-in-time feature aggregate over a CTE named ``pit`` (events + as_of).
FEATURE_AGG = """agg AS (
  SELECT lead_id,
    CAST(floor((epoch_us(max(as_of)) - epoch_us(max(occurred_at) FILTER (WHERE event_type = 'page_view'))) / 86400000000.0) AS BIGINT) AS dslv,
    CAST(floor((epoch_us(max(as_of)) - epoch_us(max(occurred_at) FILTER (WHERE event_type = 'email_open'))) / 86400000000.0) AS BIGINT) AS dsleo,
    CAST(floor((epoch_us(max(as_of)) - epoch_us(min(occurred_at))) / 86400000000.0) AS BIGINT) AS dsft,
    count(*) FILTER (WHERE event_type = 'page_view' AND occurred_at >= as_of - INTERVAL 7 DAY) AS pv7,
    count(*) FILTER (WHERE event_type = 'page_view' AND occurred_at >= as_of - INTERVAL 30 DAY) AS pv30,
    count(*) FILTER (WHERE event_type = 'email_open' AND occurred_at >= as_of - INTERVAL 30 DAY) AS eo30,
    count(*) FILTER (WHERE event_type = 'email_click' AND occurred_at >= as_of - INTERVAL 30 DAY) AS ec30,
    count(*) FILTER (WHERE event_type = 'page_view' AND event_name = 'Pricing') AS pricing,
    bool_or(event_type = 'page_view' AND event_name = 'Pricing') AS vp,
    bool_or(event_type = 'form_submission' AND event_name = 'Demo Request') AS rd,
    bool_or(event_type = 'form_submission' AND event_name = 'Content Download') AS dc,
    bool_or(event_type = 'page_view' AND event_name = 'Competitor Comparison') AS vcc,
    CAST(sum(CASE WHEN occurred_at >= as_of - INTERVAL 84 HOUR
                  THEN CASE WHEN event_type = 'email_unsubscribe' THEN -1 ELSE 1 END
                  WHEN occurred_at >= as_of - INTERVAL 7 DAY
                  THEN CASE WHEN event_type = 'email_unsubscribe' THEN 1 ELSE -1 END
                  ELSE 0 END) AS BIGINT) AS vel
  FROM pit GROUP BY lead_id
),
sess AS (
  SELECT lead_id, session_id, count(*) AS n,
         epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)) AS dur_us
  FROM pit WHERE event_type = 'page_view' AND session_id IS NOT NULL AND session_id <> ''
  GROUP BY lead_id, session_id
),
sagg AS (
  SELECT lead_id, count(*) AS ns, avg(n) AS app,
         CAST(sum(dur_us) AS DOUBLE) / count(*) / 1e6 AS asd FROM sess GROUP BY lead_id
)"""

FEATURE_COLUMNS = """
    coalesce(agg.dslv, 365) AS days_since_last_visit,
    coalesce(agg.dsleo, 365) AS days_since_last_email_open,
    coalesce(agg.dsft, 0) AS days_since_first_touch,
    coalesce(agg.pv7, 0) AS total_pageviews_7d,
    coalesce(agg.pv30, 0) AS total_pageviews_30d,
    coalesce(sagg.ns, 0) AS total_sessions,
    coalesce(agg.eo30, 0) AS emails_opened_30d,
    coalesce(agg.ec30, 0) AS emails_clicked_30d,
    coalesce(sagg.app, 0.0) AS avg_pages_per_session,
    coalesce(sagg.asd, 0.0) AS avg_session_duration_seconds,
    coalesce(agg.pricing, 0) AS pricing_page_views,
    coalesce(agg.vp, false) AS viewed_pricing,
    coalesce(agg.rd, false) AS requested_demo,
    coalesce(agg.dc, false) AS downloaded_content,
    coalesce(agg.vcc, false) AS visited_competitor_comparison,
    'unknown' AS company_size_bucket,
    false AS industry_match_icp,
    'unknown' AS job_title_seniority,
    coalesce(agg.vel, 0) AS engagement_velocity_7d,
    coalesce(agg.vel, 0) > 0 AS is_engagement_increasing"""

REQUESTS = """req AS (
  SELECT doc_id * 2 AS lead_id, doc_id AS position FROM labels
  UNION ALL
  SELECT doc_id * 2 AS lead_id, -doc_id - 1 AS position FROM labels WHERE toxic = 1
)"""

LABELLED = f"""lat AS (SELECT lead_id, max(occurred_at) AS latest_event_at FROM ev GROUP BY lead_id),
lab AS (
  SELECT l.lead_id, l.converted,
    CASE WHEN l.converted AND l.converted_at IS NOT NULL THEN l.converted_at - INTERVAL 1 DAY
         ELSE least(l.created_at + INTERVAL 90 DAY, {NOW}, coalesce(lat.latest_event_at, {NOW})) END AS as_of
  FROM leads l LEFT JOIN lat ON lat.lead_id = l.lead_id
  WHERE l.converted IS NOT NULL AND NOT (l.converted AND l.converted_at IS NULL)
)"""

MODEL_FEATURE_LIST = """days_since_last_visit, days_since_last_email_open, days_since_first_touch,
  total_pageviews_7d, total_pageviews_30d, total_sessions, emails_opened_30d, emails_clicked_30d,
  avg_pages_per_session, avg_session_duration_seconds, pricing_page_views, engagement_velocity_7d,
  viewed_pricing, requested_demo, downloaded_content, visited_competitor_comparison, is_engagement_increasing"""


# ---------------------------------------------------------------------------
# Raw lead cleaning, generated per column
# ---------------------------------------------------------------------------
from propensity.constants import CSV_COLUMN_MAP, CSV_NA_TOKENS, NUMERIC_CSV_COLUMNS, YES_NO_CSV_COLUMNS  # noqa: E402
from propensity.functions.cleaning import STRIP_PATTERN  # noqa: E402

RAW_COLUMNS = ["Prospect ID", "Lead Number"] + [c for c, _ in CSV_COLUMN_MAP if c != "Prospect ID"]
NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def q(name: str) -> str:
    return '"' + name + '"'


def sql_number(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '{NUM_RE}') THEN TRY_CAST({x} AS DOUBLE) "
            f"WHEN regexp_full_match(lower({x}), '[+-]?(inf|infinity)') "
            f"THEN CASE WHEN starts_with({x}, '-') THEN -'Infinity'::DOUBLE ELSE 'Infinity'::DOUBLE END END")


def clean_ctes() -> str:
    tokens = ", ".join("'" + t + "'" for t in CSV_NA_TOKENS)
    na = ",\n    ".join(f"CASE WHEN {q(c)} IN ({tokens}) THEN NULL ELSE {q(c)} END AS {q(c)}" for c in RAW_COLUMNS)
    st = ",\n    ".join(f"regexp_replace({q(c)}, '{STRIP_PATTERN}', '', 'g') AS {q(c)}" for c in RAW_COLUMNS)
    ph = ",\n    ".join(f"CASE WHEN lower({q(c)}) = 'select' OR {q(c)} = '' THEN NULL ELSE {q(c)} END AS {q(c)}"
                        for c in RAW_COLUMNS)
    typed = []
    for src, dst in CSV_COLUMN_MAP:
        if src in YES_NO_CSV_COLUMNS:
            typed.append(f"coalesce({q(src)} = 'Yes', false) AS {dst}")
        elif src == "Converted":
            n = sql_number(q(src))
            typed.append(f"CASE WHEN ({n}) = 1 THEN true WHEN ({n}) = 0 THEN false END AS {dst}")
        elif src in NUMERIC_CSV_COLUMNS:
            typed.append(f"{sql_number(q(src))} AS {dst}")
        else:
            typed.append(f"{q(src)} AS {dst}")
    typed_s = ",\n    ".join(typed)
    return raw_leads_cte() + f""",
na AS (SELECT input_order,
    {na}
  FROM raw),
st AS (SELECT input_order,
    {st}
  FROM na),
ph AS (SELECT input_order,
    {ph}
  FROM st),
cleaned AS (SELECT
    {typed_s},
    input_order
  FROM ph),
valid AS (SELECT *, 'kaggle' AS source_system FROM cleaned
  WHERE external_id IS NOT NULL AND regexp_replace(external_id, '{STRIP_PATTERN}', '', 'g') <> ''),
rejected AS (SELECT * FROM cleaned
  WHERE NOT (external_id IS NOT NULL AND regexp_replace(external_id, '{STRIP_PATTERN}', '', 'g') <> '')),
inserted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY input_order) AS rn
  FROM valid) x WHERE rn = 1)"""

CRM = """crm AS (
  SELECT c_custkey AS lead_id,
    ['1', '7', '10', '11-50', '51-200', '201-500', '501-1000', '1001-5000', '5001-10000', '10000+', 'unknown',
     ' 11-50 ', '12', ''][c_custkey % 14 + 1] AS company_size,
    ['Technology', 'Software', 'SaaS', 'Retail', 'Financial Services', 'Healthcare', 'Internet'][c_nationkey % 7 + 1]
      AS industry,
    ['CEO', 'VP Sales', 'Engineer', 'Head of Growth', 'Analyst', 'Director of IT', 'Chief of Staff', 'Manager',
     'vice president, marketing'][(c_custkey // 2) % 9 + 1] AS job_title
  FROM customer
)"""

REGISTRY = """reg AS (
  SELECT CASE WHEN s_suppkey % 6 = 5
              THEN 'v' || CAST(s_nationkey % 5 + 1 AS VARCHAR) || '.' || CAST(s_suppkey AS VARCHAR) || '.1'
              ELSE 'v' || CAST(s_nationkey % 5 + 1 AS VARCHAR) || '.' || CAST(s_suppkey AS VARCHAR) END AS version,
         s_suppkey = 7 AS is_active, s_suppkey
  FROM supplier
)"""

PREDICTIONS = HOLDOUT + """,
pred AS (
  SELECT ho.id AS lead_id, ho.p AS score,
    CASE WHEN ho.p >= 0.7 THEN 'A' WHEN ho.p >= 0.4 THEN 'B' WHEN ho.p >= 0.2 THEN 'C'
         WHEN ho.p IS NOT NULL THEN 'D' END AS bucket,
    CASE WHEN l.toxic = 1 THEN 'v1.1' ELSE 'v1.0' END AS model_version
  FROM ho JOIN labels l ON l.doc_id = ho.id
)"""

PREDICTION_LOG = PREDICTIONS + """,
log AS (
  SELECT lead_id, score, bucket, model_version,
         TIMESTAMP '2024-01-25 00:00:00' - to_hours(CAST(lead_id % 30 AS INTEGER)) AS scored_at FROM pred
  UNION ALL
  SELECT lead_id, s, CASE WHEN s >= 0.7 THEN 'A' WHEN s >= 0.4 THEN 'B' WHEN s >= 0.2 THEN 'C' WHEN s IS NOT NULL THEN 'D' END,
         'v1.2', TIMESTAMP '2024-01-25 00:00:00' - to_hours(CAST(lead_id * 7 % 30 AS INTEGER))
  FROM (SELECT lead_id, 1 - score AS s FROM pred)
)"""

# Rows that break every rule of their table, as expressions that Spark and DuckDB both read.
BAD_PREDICTIONS = """doc_id AS id,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN -doc_id - 1 ELSE doc_id % 100 + 1 END AS lead_id,
  CASE WHEN doc_id % 17 = 2 THEN NULL ELSE 0.5 END AS score,
  CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 = 4 THEN 'E' WHEN doc_id % 7 = 5 THEN repeat('A', 11) ELSE 'B' END AS bucket,
  CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN 'v' || repeat('1', 20) ELSE 'v1.0' END AS model_version,
  CASE WHEN doc_id % 12 = 5 THEN NULL ELSE 1 END AS scored_at"""
BAD_SYNC_LOGS = """doc_id AS id,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN -doc_id - 1 ELSE doc_id % 100 + 1 END AS lead_id,
  CASE WHEN doc_id % 17 = 2 THEN NULL WHEN doc_id % 17 = 3 THEN repeat('h', 21) ELSE 'hubspot' END AS source_system,
  CASE WHEN doc_id % 8 = 3 THEN repeat('x', 101) WHEN doc_id % 8 = 4 THEN NULL ELSE 'c-1' END AS external_id,
  CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN repeat('a', 51) ELSE 'score_update' END AS action,
  CASE WHEN doc_id % 12 = 5 THEN NULL WHEN doc_id % 12 = 6 THEN 'invalid' WHEN doc_id % 12 = 7 THEN repeat('s', 21)
       ELSE 'pending' END AS status"""
BAD_REGISTRY = """s_suppkey AS id,
  CASE WHEN s_suppkey % 5 = 1 THEN NULL WHEN s_suppkey % 5 = 2 THEN 'v1.7' WHEN s_suppkey % 5 = 3 THEN 'v' || repeat('9', 20)
       ELSE 'v2.' || CAST(s_suppkey AS VARCHAR(10)) END AS version,
  CASE WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 2 THEN repeat('p', 501) ELSE 'models/x' END AS artifact_path,
  CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE 1 END AS trained_at"""


def broken_rules(rows: str, source: str, required: list[str], limits: list[tuple[str, int]], one_of: dict[str, list[str]],
                 unique: list[str] = (), lead: str | None = None) -> str:
    """(id, rule) of every rule that a row of ``SELECT rows FROM source`` breaks."""
    parts = [f"SELECT id, 'not_null:{c}' AS rule FROM t WHERE {c} IS NULL" for c in required]
    parts += [f"SELECT id, 'max_length:{c}' FROM t WHERE length({c}) > {n}" for c, n in limits]
    parts += ["SELECT id, 'check:%s' FROM t WHERE %s NOT IN (%s)" % (c, c, ", ".join(f"'{v}'" for v in vs)) for c, vs in one_of.items()]
    parts += [f"SELECT id, 'unique:{c}' FROM t WHERE {c} IN (SELECT {c} FROM t GROUP BY {c} HAVING count(*) > 1)" for c in unique]
    if lead:
        parts.append(f"SELECT id, 'fk:{lead}' FROM t WHERE {lead} NOT IN (SELECT c_custkey FROM customer)")
    return f"WITH t AS (SELECT {rows} FROM {source})\n" + "\nUNION ALL ".join(parts)
