"""CRM mapping rules: company-size buckets, ideal-customer-profile match,
decision-maker titles, and field renames between the internal schema and CRMs."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: raw CRM company size -> internal bucket.
COMPANY_SIZE_MAP = {
    "1": "1-10", "2": "1-10", "3": "1-10", "4": "1-10", "5": "1-10",
    "6": "1-10", "7": "1-10", "8": "1-10", "9": "1-10", "10": "1-10",
    "11-50": "11-50", "51-200": "51-200",
    "201-500": "201-1000", "501-1000": "201-1000",
    "1001-5000": "1000+", "5001-10000": "1000+", "10000+": "1000+",
}
# FIXED VALUES: ordered size buckets (the catalogue's categories).
SIZE_BUCKETS = ("unknown", "1-10", "11-50", "51-200", "201-1000", "1000+")
# FIXED VALUES: ideal customer profile.
ICP_INDUSTRIES = ("Technology", "Software", "SaaS", "Information Technology", "Computer Software",
                  "Internet", "Financial Services", "Marketing and Advertising")
ICP_MIN_SIZE = "11-50"
DECISION_MAKER_TITLES = ("CEO", "CTO", "CFO", "COO", "CMO", "VP", "Vice President", "Director", "Head of", "Chief")

# FIXED VALUES: internal field -> CRM field.
CRM_FIELDS = {
    "hubspot": {
        "email": "email", "first_name": "firstname", "last_name": "lastname", "company_name": "company",
        "company_size": "numberofemployees", "job_title": "jobtitle", "industry": "industry", "phone": "phone",
        "lifecycle_stage": "lifecyclestage", "lead_status": "hs_lead_status", "created_at": "createdate",
        "updated_at": "lastmodifieddate",
        "score": "lead_score", "bucket": "lead_score_bucket", "top_factors": "lead_score_factors",
        "scored_at": "lead_score_updated", "model_version": "lead_score_model_version",
    },
    "salesforce": {
        "email": "Email", "first_name": "FirstName", "last_name": "LastName", "company_name": "Company",
        "company_size": "NumberOfEmployees", "job_title": "Title", "industry": "Industry", "phone": "Phone",
        "lead_status": "Status", "created_at": "CreatedDate", "updated_at": "LastModifiedDate",
        "score": "Lead_Score__c", "bucket": "Lead_Score_Bucket__c", "top_factors": "Lead_Score_Factors__c",
        "scored_at": "Lead_Score_Updated__c", "model_version": "Lead_Score_Model_Version__c",
    },
}
# FIXED VALUES: CRM event names (note form_submit and meeting_booked differ from internal types).
HUBSPOT_EVENT_TYPES = {"pageview": "PAGE_VIEW", "email_open": "EMAIL_OPEN", "email_click": "EMAIL_CLICK",
                       "form_submit": "FORM_SUBMISSION", "meeting_booked": "MEETING_BOOKED"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def normalize_company_size(raw: Column | str) -> Column:
    """Raw size text (stripped) -> bucket; anything unmapped -> 'unknown'."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.try_element_at(_map(COMPANY_SIZE_MAP), F.trim(c)), F.lit("unknown"))


def size_ordinal(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in SIZE_BUCKETS]), bucket)


def icp_match(industry: Column | str, size_bucket: Column | str) -> Column:
    """Target industry and a size bucket at least the minimum (never NULL)."""
    i = F.col(industry) if isinstance(industry, str) else industry
    s = F.col(size_bucket) if isinstance(size_bucket, str) else size_bucket
    ok = i.isin(*ICP_INDUSTRIES) & (size_ordinal(s) >= size_ordinal(F.lit(ICP_MIN_SIZE)))
    return F.coalesce(ok, F.lit(False))


def is_decision_maker(title: Column | str) -> Column:
    """Title contains one of the decision-maker keywords (case-insensitive)."""
    t = F.col(title) if isinstance(title, str) else title
    pattern = "(?i)(" + "|".join(re.escape(x) for x in DECISION_MAKER_TITLES) + ")"
    return F.coalesce(F.regexp_like(t, F.lit(pattern)), F.lit(False))


def crm_rename(df: DataFrame, system: str, direction: str = "out") -> DataFrame:
    """Rename mapped columns internal -> CRM (``out``) or CRM -> internal (``in``);
    unmapped columns are kept as they are."""
    m = CRM_FIELDS[system]
    if direction == "in":
        m = {v: k for k, v in m.items()}
    return df.select(*[F.col(f"`{c}`").alias(m.get(c, c)) for c in df.columns])


# Internal event type of each CRM event key whose name differs from it; meeting_booked has none.
_INTERNAL_EVENT = {"pageview": "page_view", "email_open": "email_open", "email_click": "email_click",
                   "form_submit": "form_submission"}


def crm_event_type(col: Column | str, direction: str = "out") -> Column:
    """Internal event type -> HubSpot event type (``out``), or back (``in``); NULL where the other
    side has no such event (an unsubscription, a booked meeting, anything unknown)."""
    c = F.col(col) if isinstance(col, str) else col
    pairs = {_INTERNAL_EVENT[k]: v for k, v in HUBSPOT_EVENT_TYPES.items() if k in _INTERNAL_EVENT}
    if direction == "in":
        pairs = {v: k for k, v in pairs.items()}
    return F.try_element_at(_map(pairs), c)
