"""Holdout metrics of a probabilistic binary classifier, computed on executors.

Inputs are a DataFrame with a 0/1 (or boolean) label and a probability column.
Exact AUC uses a distributed prefix sum over distinct scores; exact quantile
edges for the calibration error use a distributed global rank; everything else
is one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity.constants import ECE_BINS
from propensity.operators.windows import global_rank, prefix_sums

EPS = 2.220446049250313e-16  # float64 machine epsilon (probability clipping)


def _y(label: str) -> Column:
    return F.col(label).cast("int")


def auc_roc(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Tie-aware ROC AUC: P(score of a positive > score of a negative) + 1/2 P(tie).
    One row ``auc_roc`` (NULL when a class is missing)."""
    y = _y(label)
    per_score = df.groupBy(score).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ps = prefix_sums(per_score, [score], ["neg"])
    agg = ps.agg(F.sum(F.col("pos") * (F.col("_before_neg") + F.col("neg") * F.lit(0.5))).alias("_num"),
                 F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                             F.col("_num") / (F.col("_p") * F.col("_n"))).alias("auc_roc"))


def confusion_metrics(df: DataFrame, label: str = "y", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """precision, recall, f1 at ``score > threshold`` (0 when undefined), plus counts."""
    y = _y(label)
    pred = F.col(score) > F.lit(threshold)
    agg = df.agg(F.count_if(pred & (y == 1)).alias("tp"), F.count_if(pred & (y == 0)).alias("fp"),
                 F.count_if(~pred & (y == 1)).alias("fn"), F.count_if(~pred & (y == 0)).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(F.lit(0.0))
    return agg.select("tp", "fp", "fn", "tn",
                      safe(tp, tp + fp).alias("precision"),
                      safe(tp, tp + fn).alias("recall"),
                      safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def log_loss(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Mean binary cross-entropy with probabilities clipped to [eps, 1 - eps]."""
    y = _y(label).cast("double")
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1.0 - EPS))
    return df.agg(F.avg(-(y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p))).alias("log_loss"))


def quantile_edges(df: DataFrame, score: str = "p", n_bins: int = ECE_BINS) -> list[float]:
    """Exact linear-interpolated quantiles at 0, 1/n, ..., 1 (numpy's default).

    The global rank is distributed; only the 2 * (n + 1) order statistics the
    interpolation needs reach the driver (a bounded list, independent of data size).
    """
    # Only the values at given ranks are read, and tied scores are equal values, so
    # ordering by the score alone is enough (no non-deterministic tie-breaker).
    ranked = global_rank(df.select(score), [score])
    total = ranked.select("_total").limit(1).collect()
    if not total:
        return []
    n = total[0][0]
    wanted = {}
    for i in range(n_bins + 1):
        h = (n - 1) * i / n_bins
        lo = math.floor(h)
        wanted[i] = (h, lo)
    ranks = sorted({lo + 1 for _, lo in wanted.values()} | {min(lo + 2, n) for _, lo in wanted.values()})
    vals = dict(ranked.where(F.col("_rank").isin(ranks)).select("_rank", score).collect())
    edges = []
    for i in range(n_bins + 1):
        h, lo = wanted[i]
        a, b = vals[lo + 1], vals[min(lo + 2, n)]
        edges.append(a + (h - lo) * (b - a))
    return edges


def calibration_error(df: DataFrame, label: str = "y", score: str = "p", n_bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error over equal-frequency bins: edges are the exact
    quantiles with the first set to 0 and the last to 1 + 1e-8; bins [lo, hi);
    empty bins skipped; sum of n_bin / N * |mean label - mean probability|."""
    edges = quantile_edges(df, score, n_bins)
    if not edges:
        return df.sparkSession.createDataFrame([(0.0,)], "calibration_error double")
    edges[0], edges[-1] = 0.0, 1.0 + 1e-8
    p = F.col(score)
    b = None
    for i in range(n_bins):
        cond = (p >= F.lit(edges[i])) & (p < F.lit(edges[i + 1]))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    binned = df.select(b.alias("_bin"), _y(label).cast("double").alias("_y"), p.alias("_p"))
    # the NULL bin (never hit by probabilities in [0, 1]) still counts toward N
    per_bin = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_acc"),
                                         F.avg("_p").alias("_conf"))
    gap = F.when(F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_acc") - F.col("_conf")))
    return per_bin.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("_n")).alias("calibration_error"))


def evaluate(df: DataFrame, label: str = "y", score: str = "p") -> dict[str, float]:
    """All holdout metrics as a small dict (each a one-row aggregate)."""
    out = {"auc_roc": auc_roc(df, label, score).first()[0]}
    cm = confusion_metrics(df, label, score).first()
    out.update(precision=cm["precision"], recall=cm["recall"], f1=cm["f1"])
    out["log_loss"] = log_loss(df, label, score).first()[0]
    out["calibration_error"] = calibration_error(df, label, score).first()[0]
    return {k: (float(v) if v is not None else None) for k, v in out.items()}
