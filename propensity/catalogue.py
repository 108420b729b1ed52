"""Feature catalogue (the 20 named features) and the feature-builder registry.

The catalogue is metadata: name, category, type, default and the closed category
list for categorical features.  Computation lives in ``operators.features``; a
user can bind an extra aggregate expression to a catalogued name with
``with_builder``.  A builder is ``(as_of: Column) -> Column`` and must be an
aggregate over the point-in-time event rows of one lead (columns ``event_type``,
``event_name``, ``occurred_at``, ``session_id``, ``properties``).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any, Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

FeatureBuilder = Callable[[Column], Column]


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    type: str  # numeric | boolean | categorical
    default: Any
    categories: tuple[str, ...] = field(default_factory=tuple)


# FIXED VALUES: the catalogue (name, category, type, default, categories), in order.
FEATURES: tuple[Feature, ...] = (
    Feature("days_since_last_visit", "recency", "numeric", 365),
    Feature("days_since_last_email_open", "recency", "numeric", 365),
    Feature("days_since_first_touch", "recency", "numeric", 0),
    Feature("total_pageviews_7d", "frequency", "numeric", 0),
    Feature("total_pageviews_30d", "frequency", "numeric", 0),
    Feature("total_sessions", "frequency", "numeric", 0),
    Feature("emails_opened_30d", "frequency", "numeric", 0),
    Feature("emails_clicked_30d", "frequency", "numeric", 0),
    Feature("avg_pages_per_session", "intensity", "numeric", 0),
    Feature("avg_session_duration_seconds", "intensity", "numeric", 0),
    Feature("pricing_page_views", "intensity", "numeric", 0),
    Feature("viewed_pricing", "intent", "boolean", False),
    Feature("requested_demo", "intent", "boolean", False),
    Feature("downloaded_content", "intent", "boolean", False),
    Feature("visited_competitor_comparison", "intent", "boolean", False),
    Feature("company_size_bucket", "firmographic", "categorical", "unknown",
            ("unknown", "1-10", "11-50", "51-200", "201-1000", "1000+")),
    Feature("industry_match_icp", "firmographic", "boolean", False),
    Feature("job_title_seniority", "firmographic", "categorical", "unknown",
            ("unknown", "individual_contributor", "manager", "director", "vp", "c_level")),
    Feature("engagement_velocity_7d", "engagement", "numeric", 0),
    Feature("is_engagement_increasing", "engagement", "boolean", False),
)

# Features whose computation is built in (the firmographic three are catalogue-only).
BUILTIN_COMPUTED = frozenset(f.name for f in FEATURES if f.category != "firmographic")

# Spark type of each feature column in the feature matrix.
_NUMERIC_DOUBLE = frozenset({"avg_pages_per_session", "avg_session_duration_seconds"})


def spark_type(feature: Feature) -> T.DataType:
    if feature.type == "boolean":
        return T.BooleanType()
    if feature.type == "categorical":
        return T.StringType()
    return T.DoubleType() if feature.name in _NUMERIC_DOUBLE else T.LongType()


@dataclass(frozen=True)
class Catalogue:
    """Features in order, and the user's aggregate builders by feature name."""

    features: tuple[Feature, ...] = FEATURES
    builders: Mapping[str, FeatureBuilder] = MappingProxyType({})

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.features)

    def __getitem__(self, name: str) -> Feature:
        return {f.name: f for f in self.features}[name]


def with_builder(catalogue: Catalogue, name: str, builder: FeatureBuilder) -> Catalogue:
    """The same catalogue with ``name`` computed by ``builder``, also where it is built in.
    A name that the catalogue lacks raises ``KeyError``."""
    return replace(catalogue, builders=MappingProxyType({**catalogue.builders, catalogue[name].name: builder}))


def by_origin(catalogue: Catalogue) -> tuple[frozenset[str], frozenset[str]]:
    """The names that are computed, and those that only have a default."""
    computed = frozenset(catalogue.names) & (BUILTIN_COMPUTED | catalogue.builders.keys())
    return computed, frozenset(catalogue.names) - computed


def catalogue_table(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """One row per feature: ordinal, name, category, type, default_value, categories, computed."""
    computed, _ = by_origin(catalogue)
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame(
        [(i, f.name, f.category, f.type, text(f.default), list(f.categories) or None, f.name in computed)
         for i, f in enumerate(catalogue.features, start=1)],
        "ordinal int, name string, category string, type string, default_value string, "
        "categories array<string>, computed boolean")


default_catalogue = Catalogue()
