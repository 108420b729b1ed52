"""Fixed values.

FIXED VALUES: everything in this module must equal the values the original
pipeline uses, otherwise results differ.  They are listed plainly, in their
natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: event model ------------------------------------------------
EVENT_TYPES = ("page_view", "email_open", "email_click", "form_submission", "email_unsubscribe")

PAGE_NAMES = (
    "Blog Post", "About Us", "Pricing", "Features",
    "Competitor Comparison", "Case Studies", "Documentation", "Contact Us",
)
FORM_NAMES = ("Demo Request", "Content Download", "Newsletter Signup")

# --- FIXED VALUES: raw lead CSV -> table columns (output order = this order) ----
CSV_COLUMN_MAP = (
    ("Prospect ID", "external_id"),
    ("Lead Origin", "lead_origin"),
    ("Lead Source", "lead_source"),
    ("Do Not Email", "do_not_email"),
    ("Do Not Call", "do_not_call"),
    ("Converted", "converted"),
    ("TotalVisits", "total_visits"),
    ("Total Time Spent on Website", "total_time_spent"),
    ("Page Views Per Visit", "page_views_per_visit"),
    ("Last Activity", "last_activity"),
    ("Country", "country"),
    ("Specialization", "specialization"),
    ("What is your current occupation", "current_occupation"),
    ("City", "city"),
    ("Tags", "tags"),
)
YES_NO_CSV_COLUMNS = ("Do Not Email", "Do Not Call")
LABEL_CSV_COLUMN = "Converted"
NUMERIC_CSV_COLUMNS = ("TotalVisits", "Total Time Spent on Website", "Page Views Per Visit")
SOURCE_SYSTEM = "kaggle"

# Strings pandas.read_csv turns into missing values by default (public pandas docs).
CSV_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- FIXED VALUES: table constraints ---------------------------------------
LEAD_VARCHAR_LIMITS = (
    ("external_id", 50), ("source_system", 20), ("lead_origin", 50),
    ("lead_source", 100), ("country", 100), ("city", 100), ("current_occupation", 100),
    ("specialization", 100), ("last_activity", 100), ("tags", 200),
)
EVENT_VARCHAR_LIMITS = (("event_type", 30), ("event_name", 100))
PREDICTION_BUCKETS = ("A", "B", "C", "D")
PREDICTION_VARCHAR_LIMITS = (("bucket", 10), ("model_version", 20))
SYNC_STATUSES = ("success", "failed", "pending")
SYNC_VARCHAR_LIMITS = (("source_system", 20), ("external_id", 100), ("action", 50), ("status", 20))
REGISTRY_VARCHAR_LIMITS = (("version", 20), ("artifact_path", 500))

# --- FIXED VALUES: features -------------------------------------------------
NUMERIC_FEATURES = (
    "days_since_last_visit", "days_since_last_email_open", "days_since_first_touch",
    "total_pageviews_7d", "total_pageviews_30d", "total_sessions",
    "emails_opened_30d", "emails_clicked_30d", "avg_pages_per_session",
    "avg_session_duration_seconds", "pricing_page_views", "engagement_velocity_7d",
)
BOOLEAN_FEATURES = (
    "viewed_pricing", "requested_demo", "downloaded_content",
    "visited_competitor_comparison", "is_engagement_increasing",
)
MODEL_FEATURES = NUMERIC_FEATURES + BOOLEAN_FEATURES
FIRMOGRAPHIC_FEATURES = ("company_size_bucket", "industry_match_icp", "job_title_seniority")

# --- FIXED VALUES: scoring ----------------------------------------------------
BUCKET_A, BUCKET_B, BUCKET_C = 0.7, 0.4, 0.2
TOP_FACTORS_N = 5

# --- FIXED VALUES: model training ---------------------------------------------
DEFAULT_HYPERPARAMETERS = {
    "n_estimators": 200,
    "max_depth": 6,
    "learning_rate": 0.1,
    "colsample_bytree": 0.8,
    "eval_metric": "logloss",
    "random_state": 42,
}
DEFAULT_PARAM_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [4, 6, 8],
    "learning_rate": [0.05, 0.1, 0.2],
}
TUNING_FOLDS = 5
TUNING_ITERATIONS = 20
TEST_FRACTION = 0.2
ECE_BINS = 10
AS_OF_HORIZON_DAYS = 90

# --- FIXED VALUES: request throttle -------------------------------------------
THROTTLE_MAX_REQUESTS = 100
THROTTLE_WINDOW_SECONDS = 60

# --- FIXED VALUES: sessions ----------------------------------------------------
SESSION_GAP_SECONDS = 1800
