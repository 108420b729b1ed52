"""Column helpers for scores: buckets, validity, top factors, feature snapshot."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from propensity.constants import BUCKET_A, BUCKET_B, BUCKET_C, PREDICTION_BUCKETS, TOP_FACTORS_N


def score_bucket(score: Column | str, a: float = BUCKET_A, b: float = BUCKET_B, c: float = BUCKET_C) -> Column:
    """A/B/C/D by inclusive lower thresholds; a NULL score stays NULL."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= a, F.lit("A")).when(s >= b, F.lit("B")).when(s >= c, F.lit("C"))
            .when(s.isNotNull(), F.lit("D")))


def valid_score(score: str = "score", bucket: str = "bucket") -> Column:
    """0 <= score <= 1 and bucket one of A-D (never NULL)."""
    ok = F.col(score).between(0.0, 1.0) & F.col(bucket).isin(*PREDICTION_BUCKETS)
    return F.coalesce(ok, F.lit(False))


def json_scalar(c: Column) -> Column:
    """JSON text of one value (booleans stay true/false, strings get quotes)."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def ordered_factors(names: list[str], importances: list[float], n: int = TOP_FACTORS_N) -> list[tuple[str, float]]:
    """The ``n`` features with the largest |importance|, of equal ones the first.  The
    importances belong to the model, not to a row, so the order is a literal of the plan."""
    size = np.abs(np.asarray(importances, dtype=float))
    return [(names[i], float(importances[i])) for i in np.lexsort((np.arange(len(size)), -size))[:n]]


def top_factors(names: list[str], importances: list[float], n: int = TOP_FACTORS_N) -> Column:
    """array<struct<feature, impact, value>> with each row's own feature values."""
    return F.array(*[F.struct(F.lit(nm).alias("feature"), F.lit(imp).alias("impact"),
                              json_scalar(F.col(nm)).alias("value"))
                     for nm, imp in ordered_factors(names, importances, n)])


def top_factors_by_row(names: list[str], impacts: Column, n: int = TOP_FACTORS_N) -> Column:
    """Per-row variant: ``impacts`` is an array aligned with ``names``; the ``n``
    entries with the largest |impact| (ties by position), sorted descending."""
    items = F.arrays_zip(F.array(*[F.lit(x) for x in names]).alias("feature"), impacts.alias("impact"),
                         F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("pos"))
    ranked = F.array_sort(items, lambda l, r: F.when(F.abs(l["impact"]) > F.abs(r["impact"]), -1)
                          .when(F.abs(l["impact"]) < F.abs(r["impact"]), 1)
                          .otherwise(l["pos"] - r["pos"]))
    return F.slice(ranked, 1, n)


def feature_snapshot(names: list[str]) -> Column:
    """The model's input features of one row as a JSON object."""
    return F.to_json(F.struct(*[F.col(c) for c in names]))
